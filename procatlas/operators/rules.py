"""The built-in rules."""

from __future__ import annotations

from procatlas.operators.compliance import cmp_001, cmp_002
from procatlas.operators.engine import build_ruleset
from procatlas.operators.maintenance import mnt_001, mnt_002, mnt_003, mnt_004
from procatlas.operators.reliability import rel_001, rel_002, rel_003, rel_004
from procatlas.operators.security import sec_001, sec_002, sec_003, sec_004

ALL_RULES = build_ruleset(
    [
        sec_001, sec_002, sec_003, sec_004,
        rel_001, rel_002, rel_003, rel_004,
        mnt_001, mnt_002, mnt_003, mnt_004,
        cmp_001, cmp_002,
    ]
)

"""Reading releases by component, however large the files are.

A file is any number of exports one after the other. Spark's text reader cuts it at every ``>``, so a file is spread over
as many tasks as it has splits and no line or file has to fit into a row. What a split means depends on how the text before
it ends, in an element, a comment, character data or a quoted value, and how deep. A first pass reads every split under
each of these assumptions at once (they soon agree) and leaves one small summary each; a fold over the summaries of a file says
how each split really begins. A second pass cuts the text into heads and components. Components that lie in one split
are parsed there; only those on a border, and heads, are put together by a shuffle. No task holds more than a component.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procatlas.model import Estate
from procatlas.session import written
from procatlas.sources import releases
from procatlas.sources.files import root_element

# The root of an export, that of a single process, and the element that holds the components.
RELEASE_ROOT, BARE_ROOT, CONTENTS = "bpr:release", "process", "bpr:contents"
HEAD, BARE = "head", "bare"
TEXT = "text"
_ENDS = {"cdata": "]]>", "comment": "-->", "instruction": "?>"}
_QUOTES = ('"', "'")
STATES = (TEXT, *_ENDS, *_QUOTES)
_TOKEN = re.compile(
    r"<!\[CDATA\[(?s:.*?)\]\]>|<!--(?s:.*?)-->|<\?(?s:.*?)\?>|<!(?!--|\[CDATA\[)[^>]*>"
    r"""|</([^\s>]+)[^>]*>|<([^\s/>!?<]+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
)
_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_START = re.compile(r"<([^\s/>!?<]+)")

Token = tuple[int, int, int, str]


def _open_quote(text: str, at: int) -> str:
    """The quote that is still open at the end, from a place inside a tag."""
    inside = ""
    for ch in re.findall("[\"']", text[at:]):
        inside = ch if not inside else "" if ch == inside else inside
    return inside


def tokens(text: str, state: str) -> tuple[list[Token], str]:
    """((start, end, change of depth, name) of each tag, the state at the end) of a text that ends with ``>``.

    The change is 1 for a start tag, -1 for an end tag, also for the end of a tag that began before and closes itself, and 0
    for an element without content.
    """
    out: list[Token] = []
    at = 0
    if state in _ENDS:
        end = text.find(_ENDS[state])
        if end < 0:
            return out, state
        at = end + len(_ENDS[state])
    elif state in _QUOTES:
        close = text.find(state)
        if close < 0:
            return out, state
        rest = _REST.match(text, close + 1)
        if rest is None:
            return out, _open_quote(text, close + 1)
        if rest[1].endswith("/"):
            out.append((close, rest.end(), -1, ""))
        at = rest.end()
    while True:
        for m in _TOKEN.finditer(text, at):
            start = m.start()
            if text.find("<", at, start) >= 0:
                break
            at = m.end()
            if m[2]:
                out.append((start, at, 0 if m[3].endswith("/") else 1, m[2]))
            elif m[1]:
                out.append((start, at, -1, m[1]))
        left = text.find("<", at)
        if left < 0:
            return out, TEXT
        for opening, inside in (("<![CDATA[", "cdata"), ("<!--", "comment"), ("<?", "instruction")):
            if text.startswith(opening, left):
                return out, inside
        begun = _START.match(text, left)
        quote = _open_quote(text, begun.end()) if begun else ""
        if quote:
            out.append((left, len(text), 1, begun[1]))
            return out, quote
        at = left + 1  # a stray bracket, which the parser will complain about


class Summary:
    """What a stretch of text does to the depth, and which elements begin on its three lowest levels.

    Depths count from where the stretch begins. ``starts`` has for a level the elements begun since the last one of a lower
    level: how many, how many processes and objects among them, and the last one's name.
    """

    def __init__(self, state: str = TEXT):
        self.state, self.depth, self.low = state, 0, 0
        self.starts: dict[int, list] = {}

    def feed(self, found: Iterable[Token], state: str) -> None:
        for _, _, change, name in found:
            if change < 0:
                self.depth -= 1
                if self.depth < self.low:
                    self.low = self.depth
                    self.starts = {level: s for level, s in self.starts.items() if level <= self.low + 2}
            else:
                if self.depth <= self.low + 2:
                    self._begin(self.depth, name)
                self.depth += change
        self.state = state

    def _begin(self, level: int, name: str) -> None:
        for deeper in (level + 1, level + 2):
            self.starts.pop(deeper, None)
        now = self.starts.setdefault(level, [0, 0, 0, ""])
        now[0] += 1
        now[1] += name == "process"
        now[2] += name == "object"
        now[3] = name

    def then(self, other: Summary) -> Summary:
        """This stretch with another one behind it."""
        out = Summary(other.state)
        out.depth, out.low = self.depth + other.depth, min(self.low, self.depth + other.low)
        for level in range(out.low, out.low + 3):
            new = other.starts.get(level - self.depth)
            anew = any(lower + self.depth < level for lower in other.starts)
            old = None if anew else self.starts.get(level)
            if old and new:
                out.starts[level] = [old[0] + new[0], old[1] + new[1], old[2] + new[2], new[3]]
            elif old or new:
                out.starts[level] = list(old or new)
        return out


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, str, pa.RecordBatch]]:
    """(file, block, text, rows) of runs of pieces of one split; the columns are ``h, block, value`` and more."""
    for batch in batches:
        h, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(((h[1:] != h[:-1]) | (block[1:] != block[:-1])).nonzero()[0] + 1).tolist(), len(h)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                yield int(h[a]), int(block[a]), ">".join(part.column(2).to_pylist()) + ">", part


_SUMMARY_DDL = "h long, block long, entry string, state string, depth int, low int, starts array<struct<level:int,n:long,processes:long,objects:long,name:string>>"


def _summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary of each split for each state it may begin in."""
    place, before, runs = None, {}, {}

    def rows() -> pa.RecordBatch:
        out = []
        for entry in STATES:
            first, state = before[entry]
            total = first.then(runs[state])
            starts = [{"level": k, "n": n, "processes": p, "objects": o, "name": name} for k, (n, p, o, name) in sorted(total.starts.items())]
            out.append({"h": place[0], "block": place[1], "entry": entry, "state": total.state, "depth": total.depth, "low": total.low, "starts": starts})
        return pa.RecordBatch.from_pylist(out, schema=_SUMMARY_SCHEMA)

    for h, block, text, _ in _batches(batches):
        if place != (h, block):
            if place is not None:
                yield rows()
            # before: the summary under each assumption up to where it joined a run; runs: one shared run per state.
            place, before, runs = (h, block), {s: (Summary(s), s) for s in STATES}, {s: Summary(s) for s in STATES}
        for run in runs.values():
            run.feed(*tokens(text, run.state))
        ended = {s: run.state for s, run in runs.items()}
        if len(set(ended.values())) < len(runs):  # some agree from here on
            before = {e: (first.then(runs[s]), runs[s].state) for e, (first, s) in before.items()}
            runs = {state: Summary(state) for state in set(ended.values())}
    if place is not None:
        yield rows()


_SUMMARY_SCHEMA = pa.schema([
    ("h", pa.int64()), ("block", pa.int64()), ("entry", pa.string()), ("state", pa.string()), ("depth", pa.int32()), ("low", pa.int32()),
    ("starts", pa.list_(pa.struct([("level", pa.int32()), ("n", pa.int64()), ("processes", pa.int64()), ("objects", pa.int64()), ("name", pa.string())]))),
])
_ENTRY = "state string, depth int, roots long, root string, child string, processes long, objects long, part string"


def _entries(summaries: pd.DataFrame) -> pd.DataFrame:
    """How each split of one file begins, and whether the file as a whole is balanced."""
    known: dict[int, dict[str, Summary]] = {}
    for r in summaries.itertuples():
        summary = Summary(r.state)
        summary.depth, summary.low = r.depth, r.low
        summary.starts = {s["level"]: [s["n"], s["processes"], s["objects"], s["name"]] for s in r.starts}
        known.setdefault(r.block, {})[r.entry] = summary
    now, out = Summary(), []
    for block in sorted(known):
        at = lambda level: now.starts.get(level, [0, 0, 0, ""])  # noqa: B023, E731
        part = at(2)[3] if at(1)[3] == CONTENTS and at(2)[3] in (BARE_ROOT, "object") else ""
        out.append((block, now.state, now.depth, at(0)[0], at(0)[3], at(1)[3], at(2)[1], at(2)[2], part))
        now = now.then(known[block][now.state])
    rows = pd.DataFrame(out, columns=["block", "state", "depth", "roots", "root", "child", "processes", "objects", "part"])
    return rows.assign(h=summaries["h"].iloc[0], unbalanced=now.state != TEXT or now.depth != 0 or now.low < 0)


_FRAGMENTS = pa.schema([
    ("h", pa.int64()), ("root_no", pa.int64()), ("kind", pa.string()), ("pos", pa.int64()), ("block", pa.int64()), ("fragment", pa.int64()),
    ("whole", pa.bool_()), ("text", pa.string()),
])
_FRAGMENTS_DDL = "h long, root_no long, kind string, pos long, block long, fragment long, whole boolean, text string"


class _Cutter:
    """Cuts one split into fragments of heads and components."""

    def __init__(self, h: int, block: int, entry: dict, most: int):
        self.h, self.block, self.most = h, block, most
        self.state, self.depth = entry["state"], entry["depth"]
        self.roots, self.root, self.child = entry["roots"], entry["root"], entry["child"]
        self.counts = {"process": entry["processes"], "object": entry["objects"]}
        self.last = ""
        self.fragments = 0
        self.held: list[str] = []
        self.begun = False  # whether what is held begins in this split
        self.kind = None if self.depth == 0 else self._kind_inside(entry)

    def _kind_inside(self, entry: dict) -> str | None:
        if self.root == BARE_ROOT:
            return BARE
        if self.root != RELEASE_ROOT:
            return None
        return entry["part"] or HEAD if self.depth > 2 else HEAD

    def _cut(self, text: str, done: bool) -> Iterator[dict]:
        """Hold a text of the kind at hand; hand out what is complete or large."""
        if self.kind is None:
            return
        if text:
            self.held.append(text)
        if done or sum(map(len, self.held)) > self.most:
            pos = self.counts[self.kind] - 1 if self.kind in self.counts else 0
            joined = "".join(self.held)
            if joined:
                yield {"h": self.h, "root_no": self.roots - 1, "kind": self.kind, "pos": pos, "block": self.block, "fragment": self.fragments, "whole": done and self.begun and self.kind != HEAD, "text": joined}
                self.fragments += 1
            self.held, self.begun = [], False

    def feed(self, text: str) -> Iterator[dict]:
        found, state = tokens(text, self.state)
        begin = 0
        for at, end, change, name in found:
            if change >= 0:
                if self.depth == 0:
                    self.roots, self.root, self.child, self.counts = self.roots + 1, name, "", {"process": 0, "object": 0}
                    self.kind = BARE if name == BARE_ROOT else HEAD
                    begin, self.begun = at, True
                    if name not in (RELEASE_ROOT, BARE_ROOT):  # no export: its name is all that is kept
                        yield from self._cut(f"<{name}/>", True)
                        self.kind = None
                elif self.depth == 1:
                    self.child = name
                elif self.depth == 2 and self.root == RELEASE_ROOT and self.child == CONTENTS and name in self.counts:
                    yield from self._cut(text[begin:at], True)
                    self.kind, begin, self.begun = name, at, True
                    self.counts[name] += 1
                self.depth += change
            else:
                self.depth -= 1
            if change <= 0 and self.depth <= 2:
                if self.depth == 0:
                    yield from self._cut(text[begin:end], True)
                    self.kind, begin = None, end
                elif self.depth == 2 and self.kind in self.counts:
                    yield from self._cut(text[begin:end], True)
                    self.kind, begin, self.begun = HEAD, end, False
        yield from self._cut(text[begin:], False)
        self.state = state

    def end(self) -> Iterator[dict]:
        if self.held:
            self.begun = False
            yield from self._cut("", True)


def _cut_all(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    cutter, out, size = None, [], 0
    for h, block, text, part in _batches(batches):
        if cutter is None or (cutter.h, cutter.block) != (h, block):
            out += list(cutter.end()) if cutter else []
            entry = part.column(3)[0].as_py()
            if entry is None and block > 0:
                raise RuntimeError("the splits of a file changed between two reads; keep spark.sql.files.minPartitionNum fixed")
            cutter = _Cutter(h, block, entry or {"state": TEXT, "depth": 0, "roots": 0, "root": "", "child": "", "processes": 0, "objects": 0, "part": ""}, most)
        for row in cutter.feed(text):
            out.append(row)
            size += len(row["text"])
        if size > most:
            yield pa.RecordBatch.from_pylist(out, schema=_FRAGMENTS)
            out, size = [], 0
    out += list(cutter.end()) if cutter else []
    yield pa.RecordBatch.from_pylist(out, schema=_FRAGMENTS)


@contextmanager
def _steady_splits(spark: SparkSession):
    """Splits that stay the same between two reads while executors come and go."""
    name = "spark.sql.files.minPartitionNum"
    unset = spark.conf.get(name, None) is None
    if unset:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(name)


def fragments(spark: SparkSession, path: str, glob: str | None = None, most: int = 8 << 20, listed: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(fragments, files) of all files under a path, both written.

    Fragments are ``h, root_no, kind, pos, block, fragment, whole, text``: of the export number ``root_no`` of the file ``h``, a
    piece of its head, of the process or object at ``pos``, or of a bare process; ``whole`` ones are a component each. Files
    are ``h, file, size_bytes, unbalanced``. The entries of the splits, some 60 bytes for each split that is not the first of its
    file, are broadcast up to ``listed`` of them and joined by a shuffle beyond.
    """
    with _steady_splits(spark):
        reader = spark.read.option("recursiveFileLookup", "true")
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        name = F.xxhash64("_metadata.file_path").alias("h")
        pieces = lambda: reader.option("lineSep", ">").text(path).select(name, F.col("_metadata.file_block_start").alias("block"), "value")
        listing = reader.format("binaryFile").load(path).select(name, F.col("path").alias("file"), F.col("length").alias("size_bytes"))
        summaries = written(pieces().mapInArrow(_summarise, _SUMMARY_DDL), "split-summaries")
        entries = written(summaries.groupBy("h").applyInPandas(_entries, f"h long, block long, {_ENTRY}, unbalanced boolean"), "split-entries")
        files = written(listing.join(entries.groupBy("h").agg(F.bool_or("unbalanced").alias("unbalanced")), "h", "left"), "split-files")
        later = entries.filter("block > 0").select(F.col("h").alias("at_h"), F.col("block").alias("at_block"), F.struct(*[c for c in entries.columns if c not in ("h", "block", "unbalanced")]).alias("entry"))
        if later.count() <= listed:
            later = F.broadcast(later)
        begun = pieces().join(later, (F.col("h") == F.col("at_h")) & (F.col("block") == F.col("at_block")), "left").select("h", "block", "value", "entry")
        return written(begun.mapInArrow(lambda batches: _cut_all(batches, most), _FRAGMENTS_DDL), "split-fragments"), files


def _assembled(cut: DataFrame) -> DataFrame:
    """One row per head and component: ``h, root_no, kind, pos, text``."""
    whole = cut.filter("whole").select("h", "root_no", "kind", "pos", "text")
    open_ones = cut.filter("not whole").groupBy("h", "root_no", "kind", "pos").agg(F.sort_array(F.collect_list(F.struct("block", "fragment", "text"))).alias("f"))
    return whole.unionByName(open_ones.select("h", "root_no", "kind", "pos", F.array_join(F.transform("f", lambda x: x["text"]), "").alias("text")))


def normalize_path(spark: SparkSession, path: str, glob: str | None = None, most: int = 8 << 20) -> Estate:
    """All tables of the exports in files of any size; each file may hold several, one after the other.

    An export has the same rows as if it were a file of its own, but for its id, made of file and number, and its source hash, the
    SHA-256 over those of its head and components in order. A file whose tags do not balance, or ends inside one, gives a single
    error row, and so does an export whose head or any component is not well-formed. Files are UTF-8; empty files have
    no row, and a missing last ``>`` alone is not noticed.
    """
    cut, files = fragments(spark, path, glob, most)
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    balanced = files.filter("not coalesce(unbalanced, false)").select("h", "file")
    texts = _assembled(cut).join(balanced, "h")
    parts = texts.filter(F.col("kind") != HEAD).withColumn("sha", F.sha2("text", 256)).withColumn("bytes", F.octet_length("text").cast("long"))
    inner = f"process array<{releases._WRAPPER}>, object array<{releases._WRAPPER}>, _corrupt_record string"
    wrapped = F.when(F.col("kind") != BARE, F.from_xml(F.concat(F.lit("<contents>"), "text", F.lit("</contents>")), inner, opts))
    bare = F.when(F.col("kind") == BARE, F.from_xml("text", f"struct<{releases._BARE}>", opts))
    parsed = written(parts.withColumn("rel", wrapped).withColumn("bare", bare).drop("text"), "split-parsed")
    parsed = parsed.withColumn("broken", F.coalesce(F.col("rel._corrupt_record"), F.col("bare._corrupt_record")).isNotNull())

    one = F.when(F.col("kind") == "process", F.get(releases._wrapped(F.col("rel.process"), "process"), F.lit(0))).when(
        F.col("kind") == "object", F.get(releases._wrapped(F.col("rel.object"), "object"), F.lit(0))
    ).when(F.col("kind") == BARE, releases.bare_part())
    key = ["h", "root_no"]
    placed = parsed.withColumn("c", one).withColumn("c", F.when(F.col("kind") == BARE, F.col("c")).otherwise(
        F.col("c").withField("owner_pos", F.col("pos").cast("int")).withField(
            "base_path", F.concat(F.lit(f"{releases.CONTENTS}/"), "kind", F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("]/process"))
        )
    ))
    facts = placed.groupBy(*key).agg(
        F.bool_or("broken").alias("broken_part"), F.sum("bytes").alias("part_bytes"),
        F.sort_array(F.collect_list(F.struct("c.owner_rank", "pos", "sha"))).alias("shas"),
        F.min(F.when(releases._s("c.def._bpversion") != "", F.struct("c.owner_rank", "pos", F.col("c.def._bpversion").alias("v"))))["v"].alias("bp_version"),
        F.max(F.col("kind") == BARE).alias("bare"), F.max(F.when(F.col("kind") == BARE, F.col("bare._name"))).alias("bare_name"),
    )
    heads = texts.filter(F.col("kind") == HEAD).select(*key, F.sha2("text", 256).alias("head_sha"), F.octet_length("text").cast("long").alias("head_bytes"), root_element(F.col("text")).alias("root"), F.when(
        root_element(F.col("text")) == RELEASE_ROOT, F.from_xml("text", releases.RELEASE, opts)
    ).alias("rel"))
    found = heads.join(facts, key, "full").join(files, "h", "right")
    contents = F.col("rel.`bpr:contents`")
    broken = F.coalesce(F.col("unbalanced"), F.lit(False)) | F.col("rel._corrupt_record").isNotNull() | F.coalesce("broken_part", F.lit(False))
    shas = F.concat(F.array(F.coalesce("head_sha", F.lit(""))), F.coalesce(F.transform("shas", lambda s: s["sha"]), F.array().cast("array<string>")))
    heads = written(found.select(
        *key, F.sha2(F.concat_ws("\n", "file", F.coalesce("root_no", F.lit(0)).cast("string"), F.array_join(shas, "\n")), 256).alias("release_id"),
        "file", F.coalesce(F.coalesce("head_bytes", F.lit(0)) + F.coalesce("part_bytes", F.lit(0)), F.lit(0)).alias("size_bytes"),
        F.sha2(F.array_join(shas, "\n"), 256).alias("source_hash"),
        F.when(F.col("bare"), F.lit(BARE_ROOT)).when(F.coalesce("unbalanced", F.lit(False)), F.lit(RELEASE_ROOT)).otherwise(F.coalesce("root", F.lit(""))).alias("root"),
        broken.alias("broken"), F.coalesce("rel.`bpr:package-name`", "bare_name").alias("package_name"), F.col("rel.`bpr:created`").alias("created"),
        F.when(~broken, F.coalesce("bp_version", F.lit(""))).otherwise("").alias("bp_version"), contents.isNotNull().alias("has_contents"),
        F.when(~broken, contents["work-queue"]).alias("queues"), F.when(~broken, contents["environment-variable"]).alias("variables"),
    ), "split-heads")
    sound = heads.filter("not broken").select(*key, "release_id")
    rows = placed.join(sound, key).filter("c is not null").select("release_id", "c.*")
    return releases.estate_of(spark, heads, rows)

"""Removal of repeated line runs, by prefix doubling over sequences of line ids.

All texts together are one sequence of line ids (blank lines left out, texts kept apart). Prefix
doubling ranks the run of 2^k lines at each place: ranks follow the order of the runs, and the
rank of a run of 2^(k+1) lines is that of the pair of its halves' ranks, found by sorting in
ranges. Places in the order of their ranks are the suffix array as far as runs repeat; those
whose run occurs once leave, as no longer run of theirs can repeat. Places of one rank are the
interval of the array whose common prefix has 2^k lines; the interval of any depth l between 2^k
and 2^(k+1) is that of two overlapping ranks. A repeated run of at least so many words is covered
by the least runs with that many words that begin or end at its lines; these are short, so
doubling ends at a depth bounded by the number of words. Such a run whose interval has an earlier
place is a later copy. Copies of one earlier stretch join to the maximal run that repeats it, and
its lines go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, free_name, small, tidy

#: Words that a run needs to be removed where it occurs again.
WORDS = 50
_LEAST = -(1 << 63)
_PLACE = "d long, t long, j int"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _index(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text, key in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if not text:
                    continue
                raw = text.encode()
                lines = [s for x in raw.split(b"\n") if (s := x.strip())]
                if not lines:
                    continue
                n = len(lines)
                ids = [xxhash.xxh3_128_intdigest(x) for x in lines]
                ends = np.cumsum([len(x.split()) for x in lines])
                begins = np.concatenate([[0], ends[:-1]])
                last = np.searchsorted(ends, begins + words)  # the line where the run that begins here has enough words
                first = np.searchsorted(begins, ends - words, "right") - 1  # and where the run that ends here begins
                cols[0] += [_LEAST if doc is None else doc] * n
                cols[1] += [key] * n
                cols[2] += range(n)
                cols[3] += [_signed(i >> 64) for i in ids]
                cols[4] += [_signed(i & ((1 << 64) - 1)) for i in ids]
                cols[5] += np.where(last < n, last - np.arange(n) + 1, 0).tolist()
                cols[6] += np.where(first >= 0, np.arange(n) - first + 1, 0).tolist()
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["d", "t", "j", "h1", "h2", "ahead", "back"])

    return run


def _intervals(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows (d, t, j, keys) whose keys occur again, with the first place of their interval as r and its rank in the order of the keys.

    Counts are combined before they move; then each key is one row, so a line that every document
    has makes no join uneven that Spark can't split."""
    first = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "j")).alias("r")).where("n > 1").drop("n")
    first = first.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id())
    first = scratch.write(first, f"{name}-intervals")
    found = scratch.write(rows.join(small(first), keys), name)
    scratch.drop(f"{name}-intervals")
    return found


def later_copies(docs: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """(d, t, j, l, r): runs of l lines at line j of a text that occur at an earlier place r."""
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text).alias("t"))
    lines = source.mapInArrow(tidy(_index(words)), f"{_PLACE}, h1 long, h2 long, ahead int, back int")
    lines = scratch.write(lines.distinct(), "lines")
    here = F.struct("d", "t", "j")
    asked = lines.select("d", "t", "j", F.col("ahead").alias("l")).union(
        lines.select("d", "t", F.expr("j - back + 1"), F.col("back")))
    asked = asked.where("l > 0").distinct()
    deepest = lines.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0
    ranked = _intervals(lines.select("d", "t", "j", "h1", "h2"), ["h1", "h2"], scratch, "ranked0").select("d", "t", "j", "r", "rank")
    found, k = [], 0
    while (1 << k) <= deepest and not ranked.isEmpty():
        size = 1 << k
        runs = asked.where(F.col("l").between(size, 2 * size - 1)).join(ranked, ["d", "t", "j"])
        found.append(runs.where((F.col("l") == size) & (F.col("r") != here)).select("d", "t", "j", "l", "r"))
        if size > 1:
            tail = ranked.select("d", "t", F.col("j").alias("at"), F.col("rank").alias("r2"))
            wide = runs.where(F.col("l") > size).withColumn("at", F.col("j") + F.col("l") - size).join(tail, ["d", "t", "at"])
            wide = wide.select("d", "t", "j", "l", F.col("rank").alias("r1"), "r2")
            wide = _intervals(scratch.write(wide, f"wide{k}"), ["l", "r1", "r2"], scratch, f"deep{k}")
            found.append(wide.where(F.col("r") != here).select("d", "t", "j", "l", "r"))
        if 2 * size > deepest:
            break
        half = ranked.select("d", "t", (F.col("j") - size).alias("j"), F.col("rank").alias("r2"))
        pairs = ranked.select("d", "t", "j", F.col("rank").alias("r1")).join(half, ["d", "t", "j"])
        ranked = _intervals(scratch.write(pairs, "pairs"), ["r1", "r2"], scratch, f"ranked{k + 1}").select("d", "t", "j", "r", "rank")
        k += 1
    if not found:
        return docs.sparkSession.createDataFrame([], f"{_PLACE}, l int, r struct<d:long,t:long,j:int>")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = scratch.write(out, "copies")
    scratch.drop(*(n for n in list(scratch.paths) if n != "copies"))
    return out


_RUN = pa.list_(pa.struct([("line", pa.int32()), ("lines", pa.int32()), ("first_doc", pa.int64()), ("first_line", pa.int32())]))


def _maximal(runs: list[dict]) -> list[dict]:
    """The runs that repeat one earlier stretch, joined where they meet or overlap."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: (r["d"], r["t"], r["at"] - r["j"], r["j"])):
        last = out[-1] if out else None
        if last and (r["d"], r["t"], r["at"] - r["j"]) == (last["d"], last["t"], last["at"] - last["j"]) and r["j"] <= last["j"] + last["l"]:
            last["l"] = max(last["l"], r["j"] + r["l"] - last["j"])
        else:
            out.append(dict(r))
    return sorted(out, key=lambda r: (r["j"], -r["l"], r["d"], r["at"]))


def _cut(text: str, runs: str, rest: list[str], names: list[str]):
    """Rows with texts without their runs; the columns' names come and go as they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, removed, spans = [], [], [], []
            for said, found in zip(batch.column(text).to_pylist(), batch.column(runs).to_pylist(), strict=True):
                lines = [] if said is None else said.split("\n")
                solid = [i for i, x in enumerate(lines) if x.encode().strip()] if found else []
                joined = _maximal(found or [])
                gone = {i for r in joined for i in solid[r["j"] : r["j"] + r["l"]]}
                left = [x for i, x in enumerate(lines) if i not in gone]
                texts.append(said if not gone else "\n".join(left) if any(x.strip() for x in left) else "")
                before.append(len(lines))
                removed.append(len(gone))
                spans.append([{"line": r["j"], "lines": r["l"], "first_doc": None if r["d"] == _LEAST else r["d"], "first_line": r["at"]} for r in joined])
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in rest] + [pa.array(texts, pa.string()), pa.array(before, pa.int32()), pa.array(removed, pa.int32()), pa.array(spans, _RUN)],
                names=names)

    return run


def dedup_lines(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """Texts without later copies of line runs that have at least `words` words.

    docs: doc_id, text; other columns are kept unless their name is one of the new ones. Lines
    are compared without white space at their ends; the earliest copy by doc_id (then by place)
    stays. Adds n_lines, n_removed and removed_runs: line (number among the non-blank lines),
    lines, first_doc and first_line (where the earlier copy is). text is '' if no line with words
    is left. Null text stays null, empty text empty; very long texts are taken whole; an empty
    table gives no rows. Rows that repeat doc_id and text are one document and all lose, or keep,
    the same lines. A null doc_id comes before all others."""
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lines")
    copies = later_copies(docs, scratch, words)
    doc, key, runs = (free_name(docs, x) for x in ("doc_at", "text_at", "runs_at"))
    found = F.struct("j", "l", F.col("r.d").alias("d"), F.col("r.t").alias("t"), F.col("r.j").alias("at"))
    held = copies.groupBy(F.col("d").alias(doc), F.col("t").alias(key)).agg(F.collect_set(found).alias(runs))  # of one document: no more than its lines
    held = scratch.write(held, "runs")
    new = ["text", "n_lines", "n_removed", "removed_runs"]
    kept = docs.drop(*new[1:]).withColumn("text", F.col("text").cast("string"))
    kept = kept.withColumn(key, F.xxhash64("text")).withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)))
    joined = kept.join(small(held, 1_000_000, F.size(runs)), [doc, key], "left").drop(doc, key)
    rest = [c for c in docs.columns if c not in new]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*[F.col(f"`{c}`") for c in rest]).schema)
    kind = "array<struct<line:int,lines:int,first_doc:long,first_line:int>>"
    return joined.mapInArrow(tidy(_cut("text", runs, rest, [*rest, *new])), f"{head}text string, n_lines int, n_removed int, removed_runs {kind}")


def op3_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)


def without_copies(docs: DataFrame) -> DataFrame:
    """Pipeline stage: texts without later copies, all other columns as they are (n_chars is counted anew); documents of which nothing is left go.

    Null texts and texts that were empty before stay. Of equal rows all stay or lose the same
    lines; an empty table stays empty."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    out = dedup_lines(docs.select("doc_id", "text", rest)).where(~((F.col("n_removed") > 0) & (F.col("text") == "")))
    counted = F.when(F.col("n_removed") > 0, F.length("text"))
    columns = []
    for f in docs.schema:
        own = F.col("text") if f.name == "text" else F.col(f"row.`{f.name}`")
        columns.append((F.coalesce(counted.cast(f.dataType), own) if f.name == "n_chars" else own).alias(f.name))
    return out.select(*columns)

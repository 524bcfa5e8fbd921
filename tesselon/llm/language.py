"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram is bound by
multiplying its letters' vectors, each rotated by its place; a text is the bundle (sum) of its
n-grams, a language that of its learned texts. A text gets the language whose prototype has the
largest cosine with the text's bundle. Bundles are sums of integers, so neither order nor
partitions change a result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import log
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, mix, tidy

_U = np.uint64
#: Bound n-gram vectors that a worker keeps; others are bound anew each time.
CACHED_GRAMS = 32_768
#: Characters handled together.
CHUNK = 1 << 20


class Letters:
    """Symbols of a text: the lower-case code point of letters, 0 for each run of anything else."""

    _table: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls._table is None:
            found = np.zeros(0x110000, np.uint32)
            for i in range(0x110000):
                if (c := chr(i)).isalpha():
                    low = c.lower()
                    found[i] = ord(low) if len(low) == 1 else i
            cls._table = found
        return cls._table

    @classmethod
    def symbols(cls, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        found = cls.table()[points]
        gap = found == 0
        gap[1:] &= gap[:-1]
        gap[:1] = False
        return found[~gap]


class Space:
    """The vectors of n-grams in so many dimensions."""

    def __init__(self, dims: int, gram: int):
        if gram < 2 or 21 * gram > 64:
            raise ValueError("n-grams have two or three letters")
        self.dims, self.gram = dims, gram
        self.letters: dict[int, np.ndarray] = {}
        self.codes = np.zeros(0, _U)
        self.place = np.zeros(0, np.int64)
        self.kept = np.zeros((0, dims), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            words = mix(_U((point + 1) * 0x2545F4914F6CDD1D % (1 << 64)) + np.arange(self.dims // 64, dtype=_U) * _U(0x9E3779B97F4A7C15))
            self.letters[point] = np.unpackbits(words.astype("<u8").view(np.uint8)).astype(np.int8) * 2 - 1
        return self.letters[point]

    def grams(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a text, as codes, and how often each occurs."""
        n = len(symbols) - self.gram + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        code = np.zeros(n, _U)
        for k in range(self.gram):
            code = (code << _U(21)) | symbols[k : n + k].astype(_U)
        return np.unique(code, return_counts=True)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.dims), np.int8)
        for k in range(self.gram):
            points, at = np.unique((codes >> _U(21 * (self.gram - 1 - k))) & _U((1 << 21) - 1), return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(p)), self.gram - 1 - k) for p in points])[at]
        return out

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        new = np.ones(len(codes), bool)
        inside = at < len(self.codes)
        new[inside] = self.codes[at[inside]] != codes[inside]
        if not new.any():
            return self.kept[self.place[at]]
        fresh = self.bind(codes[new])
        out = np.empty((len(codes), self.dims), np.int8)
        out[~new] = self.kept[self.place[at[~new]]]
        out[new] = fresh
        room = CACHED_GRAMS - len(self.codes)
        if room > 0:
            add = codes[new][:room]
            self.kept = np.concatenate([self.kept, fresh[:room]])
            both = np.concatenate([self.codes, add])
            place = np.concatenate([self.place, np.arange(len(self.codes), len(both))])
            order = np.argsort(both)
            self.codes, self.place = both[order], place[order]
        return out

    def counts(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct n-grams and their counts, a piece of the text at a time; the last symbols of a piece go before the next one.

        The text as a whole stands between gaps. No letter: nothing."""
        before = np.zeros(1, np.uint32)
        for at in range(0, len(text), CHUNK):
            symbols = Letters.symbols(text[at : at + CHUNK])
            again = int(before[-1] == 0 and len(symbols) > 0 and symbols[0] == 0)
            symbols = np.concatenate([before, symbols[again:]])
            if len(symbols) >= self.gram:
                yield self.grams(symbols)
            before = symbols[-(self.gram - 1) :]
        if before[-1]:
            yield self.grams(np.append(before, np.uint32(0)))

    def total(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' vectors, exact: in 32-bit floats only where no sum of theirs can pass 2**24."""
        out = np.zeros(self.dims)
        for i in range(0, len(codes), 4096):
            some = counts[i : i + 4096]
            kind = np.float32 if some.sum() < 1 << 24 else np.float64
            out += some.astype(kind) @ self.vectors(codes[i : i + 4096]).astype(kind)
        return out

    def bundle(self, text: str) -> np.ndarray | None:
        """Sum of a text's n-gram vectors; None if it has no letter."""
        parts = [self.total(*found) for found in self.counts(text)]
        return sum(parts) if parts else None


def _learn(dims: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums, grams = Space(dims, gram), {}, {}
        pending: dict[str, list] = {}
        waiting = 0

        def add():
            for lang, found in pending.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([n for _, n in found]))
                sums[lang] = sums.get(lang, 0) + space.total(codes, counts)
                grams[lang] = grams.get(lang, 0) + int(counts.sum())
            pending.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found in space.counts(text):
                    pending.setdefault(lang, []).append(found)
                    waiting += len(found[0])
                if waiting >= CHUNK:
                    add()
                    waiting = 0
        add()
        langs = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array([np.append(np.rint(sums[k]).astype(np.int64), grams[k]) for k in langs], pa.list_(pa.int64()))],
            names=["lang", "bundle"])

    return run


def _profiles(docs: DataFrame, dims: int = 1024, gram: int = 3) -> dict[str, list[float]]:
    """Of each language the sum of its n-gram vectors, and behind it the number of n-grams; one such vector a language is all that is gathered."""
    bound_batches(docs.sparkSession)
    sums = docs.select("text", "lang").mapInArrow(tidy(_learn(dims, gram)), "lang string, bundle array<long>")
    sums = sums.select("lang", F.posexplode("bundle").alias("d", "v")).groupBy("lang", "d").agg(F.sum("v").alias("v"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("parts")).collect()
    return {r.lang: [float(p.v) for p in r.parts] for r in sorted(rows, key=lambda r: r.lang)}


def learn(docs: DataFrame, *, dims: int = 1024, gram: int = 3) -> dict[str, list[float]]:
    """Prototype of each language from rows (text, lang), both non-null.

    The only thing gathered is one vector a language."""
    return {k: v[:-1] for k, v in _profiles(docs, dims, gram).items()}


def _predict(prototypes: dict[str, list[float]], dims: int, gram: int, sizes: bool = False):
    """Adds lang_pred and score; with sizes also grams, the number of n-grams."""
    langs = list(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dims, gram)
        table = np.array([prototypes[k] for k in langs]).reshape(len(langs), dims)
        table = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
        for batch in batches:
            pred, score, grams = [], [], []
            for text in batch.column("text").to_pylist():
                parts = list(space.counts(text)) if text and langs else []
                found = sum(space.total(*p) for p in parts) if parts else None
                grams.append(sum(int(n.sum()) for _, n in parts))
                if found is None:
                    pred.append("und")
                    score.append(0.0)
                    continue
                cosine = table @ found / max(float(np.linalg.norm(found)), 1e-12)
                best = int(np.argmax(cosine))
                pred.append(langs[best])
                score.append(min(1.0, max(0.0, float(cosine[best]))))
            rest = [(n, batch.column(n)) for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [c for _, c in rest] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())] + [pa.array(grams, pa.int64())] * sizes,
                names=[n for n, _ in rest] + ["lang_pred", "score"] + ["grams"] * sizes)

    return run


def predict(docs: DataFrame, prototypes: dict[str, list[float]], *, dims: int = 1024, gram: int = 3) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts (doc_id, text); score is the cosine, 0 where negative.

    Null texts, texts without a letter and all texts if nothing was learned: 'und' with score 0.
    Equal cosines: the language first in order. Repeated rows are predicted each; very long texts
    go through in pieces with the same bundle as in one; other columns than doc_id and text are
    ignored, whatever their names; an empty table gives no rows."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(_predict(prototypes, dims, gram)), "doc_id long, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _to_learn(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def learned(docs: DataFrame) -> dict[str, list[float]]:
    """Prototypes from the rows that aren't held out."""
    return learn(_to_learn(docs))


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, learned(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Chance that a text unrelated to all languages passes in the pipeline.
CHANCE = 0.001
#: How much likelier a document is of a learned language than of none, before its text is seen.
PRIOR = 100
#: How far cosines of a language's texts spread about the expected one; 0.10 to 0.13 was measured from 20 to 200 n-grams.
SPREAD = 0.12
def least_score(languages: int, dims: int = 1024) -> float:
    """The cosine that the largest of so many unrelated ones, normal with deviation dims**-0.5, exceeds by CHANCE."""
    return NormalDist().inv_cdf((1 - CHANCE) ** (1 / max(1, languages))) * dims**-0.5


def expected_score(grams: np.ndarray, share: float) -> np.ndarray:
    """The cosine that a text of so many n-grams of a language has with its prototype, on the mean.

    share: the chance that two n-grams of the language are equal. A text's n-grams meet those of the
    language n * share times over, and each other too: (n * share / (1 + n * share)) ** 0.5."""
    met = grams * share
    return np.sqrt(met / (1 + met))


def likely_score(expected: np.ndarray, dims: int = 1024) -> np.ndarray:
    """The cosine from which on a text is rather of the language than of none, by the ratio of likelihoods and PRIOR.

    Cosines of the language's texts spread by SPREAD about the expected one, those of unrelated texts by
    dims**-0.5 about 0: the log-ratio is a quadratic in the cosine, of which this is the upper root."""
    a, b = dims / 2 - 0.5 / SPREAD**2, expected / SPREAD**2
    c = log(PRIOR * dims**-0.5 / SPREAD) - 0.5 * (expected / SPREAD) ** 2
    return np.maximum((np.sqrt(np.maximum(b * b - 4 * a * c, 0)) - b) / (2 * a), 0.0)


def keep_known(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents of a recognised language, all columns as they are; those of none go.

    A text stays if its cosine is above what unrelated texts reach by chance, or, where its few n-grams
    can't be expected to reach that in a learned language either, if with this cosine it is likelier of
    that language than of none. The smaller of both bounds is one rule for texts of any length, and
    grows with the number of n-grams. Null texts and texts without a letter go. Repeated rows stay or go together. If nothing can be learned (no row has a
    language), all go; an empty table stays empty."""
    bound_batches(docs.sparkSession)
    profiles = _profiles(_to_learn(docs))
    prototypes, least = {k: v[:-1] for k, v in profiles.items()}, least_score(len(profiles))
    share = {k: sum(x * x for x in v[:-1]) / (len(v) - 1) / v[-1] ** 2 for k, v in profiles.items()} | {"und": 0.0}

    def run(batches, inner=_predict(prototypes, 1024, 3, sizes=True)):
        seen = deque()

        def watched():
            for batch in batches:
                seen.append(batch)
                yield batch

        for out in inner(watched()):  # one for each batch, in order
            lang = out["lang_pred"].to_pylist()
            bound = np.minimum(least, likely_score(expected_score(out["grams"].to_numpy(), np.array([share[k] for k in lang]))))
            known = np.array([k != "und" for k in lang], bool) & (out["score"].to_numpy() >= bound)
            yield seen.popleft().filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)

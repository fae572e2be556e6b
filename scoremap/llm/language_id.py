"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Texts are folded to lower-case letters with one space between words. Spark counts
the character 4-grams of a bounded sample of labelled rows; from the counts come,
for every order, a sorted array of n-gram hashes with one log-probability per
language and a sorted array of context hashes with one back-off weight per
language. A text gets the language of lowest cross-entropy per character, and is
rejected when even that is above what labelled rows outside the sample show. These
rows are set apart before the sample is drawn, at every size of the table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoremap.llm.common import materialize

ORDER = 4
#: Labelled rows per language that the models are fitted on, in expectation: the
#: documented bound of the sample. Drawn by a hash of the id.
SAMPLE_ROWS = 1500
#: Labelled rows per language, outside the sample, that set the rejection level; of a
#: small language this share of its rows is held out for that.
CALIBRATION_ROWS, CALIBRATION_SHARE = 500, 0.2
#: A language with fewer calibration rows than this takes the level of all languages
#: together, or its own if that is higher; below FIT_ALL rows none are held out.
MIN_CALIBRATION, FIT_ALL = 50, 8
#: Bits per character above the 99.9th percentile of the calibration rows.
REJECT_MARGIN = 0.75
#: A text of n characters must lie above the level by so much over the root of n:
#: three standard errors, as a character's surprise varies by about three bits.
ERROR_BITS = 9.0
#: Code points handled at once in a task.
BLOCK = 1 << 20
#: Characters after which the evidence for the score no longer grows.
EVIDENCE = 24
SPACE, PAD = 32, 1
WORD_CHARACTER = re.compile(r"[^\W\d_]")
_P = np.uint64(0x9E3779B97F4A7C15)


def fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or the space for all that is no letter."""
    out = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
        elif unicodedata.category(c) == "Mn":
            out[i] = i
    return out


def mixed(cp: np.ndarray) -> np.ndarray:
    """A 64-bit random value per code point (splitmix64)."""
    with np.errstate(over="ignore"):
        z = (cp.astype(np.uint64) + np.uint64(1)) * _P
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def grams(m: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters that end at each place (the first k-1 wrap)."""
    with np.errstate(over="ignore"):
        h = m.copy()
        for _ in range(1, k):
            h = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * _P + m
        return h


def folded(texts: list[str | None], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array of folded code points, each behind ORDER-1 pads;
    where each starts, and how many characters it has."""
    parts, starts, sizes, at = [], [], [], 0
    pads = np.full(ORDER - 1, PAD, np.uint32)
    for t in texts:
        x = fold[np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32)]
        if len(x):
            space = x == SPACE
            keep = ~space
            keep[1:] |= ~space[:-1]
            keep[0] = not space[0]
            x = x[keep]
            if len(x) and x[-1] == SPACE:
                x = x[:-1]
        parts += [pads, x]
        starts.append(at)
        sizes.append(len(x))
        at += len(x) + ORDER - 1
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(starts, np.int64), np.array(sizes, np.int64)


@dataclass
class Models:
    """Per order k (from 1): keys[k] sorted n-gram hashes and logp[k] (n x
    languages); ctx[k] sorted context hashes and bow[k]. floor: the uniform share."""

    langs: list[str]
    keys: dict[int, np.ndarray]
    logp: dict[int, np.ndarray]
    ctx: dict[int, np.ndarray]
    bow: dict[int, np.ndarray]
    floor: float
    fold: np.ndarray


def _at(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
    return i, table[i] == h if len(table) else np.zeros(len(h), bool)


def log_probs(models: Models, m: np.ndarray, k: int, hashes: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """log2 p of the character at each place of ``m`` given the k-1 before it."""
    h = {j: grams(m, j) for j in range(1, ORDER + 1)} if hashes is None else hashes
    n = len(h[1])
    if k == 0:
        return np.full((n, len(models.langs)), models.floor, np.float32)
    i, hit = _at(models.keys[k], h[k])
    out = models.logp[k][i] if len(models.keys[k]) else np.zeros((n, len(models.langs)), np.float32)
    miss = np.flatnonzero(~hit)
    if len(miss):
        lower = log_probs(models, m, k - 1, {j: h[j][miss] for j in h})
        with np.errstate(over="ignore"):
            # the context is the n-gram without its last character
            c = h[k][miss] - h[1][miss] if k > 1 else np.zeros(len(miss), np.uint64)
        j, seen = _at(models.ctx[k], c)
        lower[seen] += models.bow[k][j[seen]]
        out[miss] = lower
    return out


def build(langs: list[str], lang: np.ndarray, grams4: np.ndarray, count: np.ndarray, fold: np.ndarray) -> Models:
    """Interpolated Kneser-Ney from 4-gram counts (rows: language number, four code
    points, count): raw counts at the top order, numbers of distinct predecessors
    below, one absolute discount n1 / (n1 + 2 n2) per language and order."""
    chars = len(np.unique(grams4[:, -1])) if len(grams4) else 0
    models = Models(langs, {}, {}, {}, {}, float(-np.log2(chars + 1)), fold)
    levels = {ORDER: (lang, grams4, count.astype(np.float64))}
    for k in range(ORDER - 1, 0, -1):
        l, g, _ = levels[k + 1]
        rows, n = np.unique(np.column_stack([l, g[:, 1:]]), axis=0, return_counts=True)
        levels[k] = rows[:, 0], rows[:, 1:], n.astype(np.float64)
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            l, g, n = levels[k]
            last = mixed(g[:, -1])
            h = np.zeros(len(g), np.uint64)
            for j in range(k):
                h = h * _P + mixed(g[:, j])
            c = h - last if k > 1 else np.zeros(len(g), np.uint64)
            models.keys[k], first = np.unique(h, return_index=True)
            models.ctx[k] = np.unique(c)
            discount, total, kinds = np.zeros(len(langs)), np.zeros((len(models.ctx[k]), len(langs))), np.zeros((len(models.ctx[k]), len(langs)))
            for x in range(len(langs)):
                n1, n2 = (n[l == x] == 1).sum(), (n[l == x] == 2).sum()
                discount[x] = n1 / (n1 + 2 * n2) if n1 else 0.5
            ci = np.searchsorted(models.ctx[k], c)
            np.add.at(total, (ci, l), n)
            np.add.at(kinds, (ci, l), 1)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
            models.bow[k] = np.log2(np.maximum(weight, 1e-9)).astype(np.float32)
            own = np.zeros((len(models.keys[k]), len(langs)))
            np.add.at(own, (np.searchsorted(models.keys[k], h), l), np.maximum(n - discount[l], 0) / total[ci, l])
            # the shorter n-gram of each key, looked up in what is already built
            lower = np.zeros((len(first), len(langs)))
            if k == 1:
                lower += 2.0**models.floor
            else:
                s = np.zeros(len(first), np.uint64)
                for j in range(1, k):
                    s = s * _P + mixed(g[first, j])
                i, _ = _at(models.keys[k - 1], s)
                lower += 2.0 ** models.logp[k - 1][i]
            models.logp[k] = np.log2(np.maximum(own + weight[ci[first]] * lower, 1e-12)).astype(np.float32)
    return models


def entropies(models: Models, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bits per character by language for each text, and its number of characters."""
    x, starts, sizes = folded(texts, models.fold)
    out = np.zeros((len(texts), len(models.langs)))
    some = np.flatnonzero(sizes)
    if len(some):
        lp = log_probs(models, mixed(x), ORDER)
        lp[x == PAD] = 0
        out[some] = -np.add.reduceat(lp, starts[some], axis=0, dtype=np.float64) / sizes[some, None]
    return out, sizes


def _blocks(texts: Iterator[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _count(fold_of):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = fold_of.value
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                mine = (texts[i] for i in np.flatnonzero(langs == lang))
                for block in _blocks(mine):
                    x, _, _ = folded(block, fold)
                    x = x.astype(np.int64)
                    if len(x) < ORDER:
                        continue
                    g = np.column_stack([x[j : len(x) - ORDER + 1 + j] for j in range(ORDER)])
                    g = g[g[:, -1] != PAD]
                    h = (g[:, 0] << 21 | g[:, 1], g[:, 2] << 21 | g[:, 3])
                    order = np.lexsort(h[::-1])
                    a, b = h[0][order], h[1][order]
                    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, int)
                    n = np.diff(np.append(new, len(a)))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(new), pa.string()), pa.array(a[new]), pa.array(b[new]), pa.array(n)], names=["lang", "a", "b", "n"])

    return count


def has_letter(text: str | None) -> bool:
    """Whether any character is alphabetic; marks, digits and signs alone are not."""
    return any(m[0].isalpha() for m in WORD_CHARACTER.finditer(text or ""))


def _predict(model_of):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models(**model_of.value)
        for batch in batches:
            lang, score, bits, least = [], [], [], []
            for block in _blocks(t if has_letter(t) else None for t in batch.column(batch.num_columns - 1).to_pylist()):
                ce, sizes = entropies(models, block)
                best = ce.argmin(axis=1)
                low = ce[np.arange(len(ce)), best]
                evidence = np.minimum(sizes, EVIDENCE)[:, None]
                share = 1 / np.exp2(-(ce - low[:, None]) * evidence).sum(axis=1)
                lang += [models.langs[b] if n else "und" for b, n in zip(best, sizes, strict=True)]
                score += [float(s) if n else 0.0 for s, n in zip(share, sizes, strict=True)]
                bits += [float(v) if n else None for v, n in zip(low, sizes, strict=True)]
                least += [float(v) - ERROR_BITS / n**0.5 if n else None for v, n in zip(low, sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(least, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "bits_per_char", "bits_at_least"],
            )

    return predict


def held_out(id_col: str) -> Column:
    """True for the third of the ids that nothing may be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


class LanguageId:
    """Fit on labelled rows, then ``predict`` any frame."""

    def __init__(self, models: Models | None, levels: dict[str, float]):
        self.models, self.levels = models, levels

    @classmethod
    def fit(cls, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> LanguageId:
        """Rows with a null id, text or language teach nothing."""
        spark = rows.sparkSession
        known = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_t")).where("_id is not null and _lang is not null")
        counts = {r["_lang"]: r["n"] for r in known.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
        langs = sorted(counts)
        if not langs:
            return cls(None, {})
        apart = {k: min(calibration_rows / n, CALIBRATION_SHARE) if n >= FIT_ALL else 0.0 for k, n in counts.items()}
        by_lang = lambda of: F.create_map(*[F.lit(v) for k in langs for v in (k, of(k))])[F.col("_lang")]
        held, upto = by_lang(lambda k: apart[k]), by_lang(lambda k: apart[k] + sample_rows / counts[k])
        place = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) / float(1 << 20)
        known = known.where(F.col("_t").isNotNull())
        fold = fold_table()
        sample = known.where((place >= held) & (place < upto)).select("_lang", "_t")
        grams4 = sample.mapInArrow(_count(spark.sparkContext.broadcast(fold)), "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).toPandas()
        number = {k: i for i, k in enumerate(langs)}
        a, b = grams4["a"].to_numpy(np.int64), grams4["b"].to_numpy(np.int64)
        g = np.column_stack([a >> 21, a & 0x1FFFFF, b >> 21, b & 0x1FFFFF])
        if not len(g):
            return cls(None, {})
        out = cls(build(langs, grams4["lang"].map(number).to_numpy(np.int64), g, grams4["n"].to_numpy(), fold), {})
        right = materialize(out._apply(known.where(place < held).select("_lang", "_t")).where("lang_pred = _lang").select("_lang", "bits_at_least"), "calibration")
        q = F.percentile_approx("bits_at_least", 0.999, 10000).alias("q")
        own = {r["_lang"]: (r["n"], r["q"]) for r in right.groupBy("_lang").agg(F.count("*").alias("n"), q).collect()}
        # without any calibration row: the bits of a character that nothing is known of
        pooled = right.agg(q).first()["q"]
        for k in langs:
            n, level = own.get(k, (0, None))
            if n < MIN_CALIBRATION:
                level = max((v for v in (level, pooled) if v is not None), default=None)
            out.levels[k] = -out.models.floor if level is None else level + REJECT_MARGIN
        return out

    def _apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` with its last column, the text, replaced by the results."""
        # plain values: a class of this module could not be read where it is not installed
        shared = rows.sparkSession.sparkContext.broadcast(vars(self.models))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
        return rows.mapInArrow(_predict(shared), f"{fields}, lang_pred string, score double, bits_per_char double, bits_at_least double")

    def predict(self, rows: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
        """Per row: the key columns, lang_pred, score (0 to 1), bits_per_char,
        bits_at_least (the same less the error of a short text) and rejected.

        Null texts, empty texts and texts without a letter are ``und``, score 0 and
        rejected; so is everything if nothing could be learned. Equal texts get
        equal results, whatever the other columns hold.
        """
        slim = rows.select(*key_cols, F.col(text_col).alias("_text"))
        if self.models is None:
            return slim.select(*key_cols, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_char"), F.lit(None).cast("double").alias("bits_at_least"), F.lit(True).alias("rejected"))
        level = F.coalesce(*[F.when(F.col("lang_pred") == k, F.lit(v)) for k, v in self.levels.items()])
        return self._apply(slim).withColumn("rejected", F.col("bits_per_char").isNull() | (F.col("bits_at_least") > level))

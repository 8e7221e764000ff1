"""Language ID in two steps: the family, then one-versus-one linear machines within it.

A text is its trigrams of lower-cased letters as UTF-8 bytes, hashed to DIMENSIONS; everything else is a space. Naive Bayes over
trigrams tells the families apart. Within a family, a linear support vector machine for each pair of languages votes;
the languages of a family that has one need none. Scores of a text are sums over a table of weights, so
whole texts cost a few numpy passes, slice by slice. The fit takes a bounded sample, about SAMPLE texts for each language, and runs in
one task for each family, dense only for two languages at a time. All languages are learned: the driver gets, and sends out, 64 KB for
each family and for each pair of languages within one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


UNKNOWN = "und"
DIMENSIONS = 1 << 14
#: Labelled texts of each language that the fit takes (drawn by a hash of doc_id and text; fewer if there are fewer).
SAMPLE = 400
#: Characters of a text whose trigrams are made at a time.
SLICE = 1 << 19
#: Families of language codes. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "fy", "lb", "sv", "da", "no", "nb", "nn", "is", "fo"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
    "semitic": ("ar", "he", "mt"),
    "sino-japonic": ("zh", "ja"),
}

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x61, 0x7B), *range(0x80, 0x100)]


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), code)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:]))


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashed trigrams of the text between two spaces, one for each byte, slice by slice."""
    low, last = text.lower(), b" "
    for at in range(0, len(low) + 1, SLICE):
        data = last + low[at : at + SLICE].encode("utf-8", "surrogatepass") + (b" " if at + SLICE > len(low) else b"")
        last = data[-2:]
        data = _LETTERS[np.frombuffer(data, np.uint8)].astype(np.uint32)
        code = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
        yield (code[code != 0x202020] * np.uint32(0x9E3779B1)) >> np.uint32(18)


#: The columns that a family adds to the table of weights: its own, without two languages, and one for each pair.
COLUMNS = "family string, langs array<string>, one string, two string, bias double, weights binary"


def fitted(rows: pa.Table) -> pa.Table:
    """COLUMNS of one family, from its sampled texts: family, lang, draw (their order), at and times (trigrams)."""
    rows = rows.sort_by([("lang", "ascending"), ("draw", "ascending")])
    by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang, at, times in zip(rows.column("lang").to_pylist(), rows.column("at"), rows.column("times")):
        by.setdefault(lang, []).append(tuple(np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in (at, times)))
    total = np.full(DIMENSIONS, 0.5)
    for at, times in itertools.chain.from_iterable(by.values()):
        total[at] += times
    found = [(None, None, 0.0, np.log(total / total.sum()).astype(np.float32))]
    for one, two in itertools.combinations(by, 2):
        share = np.zeros((len(by[one]) + len(by[two]), DIMENSIONS), np.float32)
        for i, (at, times) in enumerate(by[one] + by[two]):
            share[i, at] = times / max(1, times.sum())
        w, b = linear_svm(share, np.where(np.arange(len(share)) < len(by[one]), 1.0, -1.0))
        found.append((one, two, b, w.astype(np.float32)))
    ones, twos, bias, tables = zip(*found)
    return pa.table({"family": [rows.column("family")[0].as_py()] * len(found), "langs": pa.array([list(by)] * len(found), pa.list_(pa.string())), "one": pa.array(ones, pa.string()), "two": pa.array(twos, pa.string()), "bias": pa.array(bias, pa.float64()), "weights": pa.array([w.tobytes() for w in tables], pa.binary())})


def counted(text: str) -> np.ndarray:
    """How often each hashed trigram occurs."""
    total = np.zeros(DIMENSIONS, np.int64)
    for grams in trigrams(text):
        total += np.bincount(grams, minlength=DIMENSIONS)
    return total


class Model:
    """Languages by family and one table of weights: a column for each family, then for each pair."""

    def __init__(self, columns: list[tuple[str, list[str], str | None, str | None, float, bytes]]):
        """columns: see COLUMNS."""
        columns = sorted(columns, key=lambda c: (c[2] is not None, c[0], c[2] or "", c[3] or ""))
        whole = [c for c in columns if c[2] is None]
        self.families = [c[0] for c in whole]
        self.within = {c[0]: list(c[1]) for c in whole}
        self.langs = sorted(x for langs in self.within.values() for x in langs)
        self.pairs = [(c[2], c[3]) for c in columns[len(whole) :]]
        self.bias = [c[4] for c in columns]
        self.weights = np.zeros((DIMENSIONS, len(columns)), np.float32)
        for i, c in enumerate(columns):
            self.weights[:, i] = np.frombuffer(c[5], np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        times = counted(text)
        size = int(times.sum())
        if not size:  # letters that no table of bytes knows
            return UNKNOWN, 0.0
        held = np.flatnonzero(times)
        scores = times[held] @ self.weights[held] / size + self.bias
        n = len(self.families)
        evidence = scores[:n] * min(size, 50)
        best = int(evidence.argmax())
        chance = 1 / np.exp(evidence - evidence[best]).sum()
        langs = self.within[self.families[best]]
        votes, margins = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for (one, two), margin in zip(self.pairs, scores[n:].tolist()):
            if one in votes:
                votes[one if margin >= 0 else two] += 1
                margins[one] += margin
                margins[two] -= margin
        lang = max(langs, key=lambda x: (votes[x], margins[x], x))
        sure = 1.0 if len(langs) == 1 else 1 / (1 + np.exp(-2 * margins[lang] / (len(langs) - 1)))
        return lang, float(min(1.0, max(0.0, chance * sure)))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """Squared hinge loss with weight decay, minimised by accelerated gradient steps over the whole sample."""
    scale = 1 / max(1e-9, float(np.sqrt((x * x).sum(1)).mean()))
    x = x.astype(np.float32) * np.float32(scale)
    w, b, mw, mb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 1 / (1 + 2 * cost * (1 + float((x * x).sum(1).max())))
    for t in range(steps):
        off = np.maximum(0, 1 - y * (x @ mw + mb)) * y * weight
        w2 = mw - rate * (mw - 2 * cost * (off.astype(np.float32) @ x))
        b2 = mb + rate * 2 * cost * float(off.sum())
        beta = t / (t + 3)
        mw, mb = w2 + beta * (w2 - w), b2 + beta * (b2 - b)
        w, b = w2, b2
    return w * np.float32(scale), b


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, times = [], []
        for text in batch.column("text"):
            own = counted(text.as_py())
            held = np.flatnonzero(own)
            at.append(held.astype(np.int32))
            times.append(own[held])
        families = [family_of(x) for x in batch.column("lang").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(families, pa.string()), batch.column("lang"), batch.column("draw"), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["family", "lang", "draw", "at", "times"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on labelled rows (doc_id, text, lang), on those of a language whose hashed id and text are under a bound set by its
    count, so about sample of them. The bounds, one number for each language, go to all tasks, as the model itself does."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 40)).alias("draw"))
    bounds = labelled.groupBy("lang").agg((F.least(F.lit(1.0), sample / F.count("*")) * (1 << 40)).cast("long").alias("bound"))
    drawn = labelled.join(F.broadcast(bounds), "lang").where("draw < bound").select("lang", "text", "draw")
    features = drawn.mapInArrow(_featured, "family string, lang string, draw long, at array<int>, times array<long>")
    return Model([tuple(r) for r in features.groupBy("family").applyInArrow(fitted, COLUMNS).collect()])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row is kept from the fit: crc32 of its id as text has remainder 2 by 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def _predicted(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [model.predict(text.as_py()) for text in batch.column("text")]
        out = batch.select([c for c in batch.schema.names if c not in ("lang_pred", "score")])
        yield out.append_column("lang_pred", pa.array([x for x, _ in found], pa.string())).append_column("score", pa.array([x for _, x in found], pa.float64()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus lang_pred and score (columns of those names are replaced), from whole texts alone.

    und with score 0 if the text is null or has no letter, or nothing was learned.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of DIMENSIONS rows
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(lambda it: _predicted(sent.value, it), schema)


def _with_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([has_letter(text.as_py() or "") for text in batch.column("text")], pa.bool_()))


def lettered(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a letter."""
    return docs.mapInArrow(_with_letters, docs.schema)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the rows of docs that are not held out."""
    return fit(docs.select("doc_id", "text", "lang").where(~F.coalesce(held_out(), F.lit(False))), sample)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that aren't held out.

    A null doc_id is not held out. An empty table gives no rows.
    """
    model = learn(docs, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, model).drop("text")

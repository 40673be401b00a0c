"""Language identification by hierarchical discrimination.

A linear support vector machine for each family tells it from the others, then one for each pair of its languages, by votes,
tells the language. Features are byte trigrams of the whole text, letters only, hashed into `WIDTH` places and weighted by the
square root of their count. The machines are fitted on the driver from a bounded sample of labelled rows; `per_lang` and
`most_rows` are that bound. Prediction sees nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.kernel import flat
from lumenspan.llm.runtime import slices

WIDTH = 4096
#: Families of language codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg sr hr bs sl sk cs pl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi ur bn mr ne pa gu",
    "semitic": "ar he mt am",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_CODE = np.zeros(256, np.uint32)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:192] = 27 + np.arange(64) % 29  # bytes inside a character, then its first byte
_CODE[192:256] = 33 + np.arange(64) % 31
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def family(code: str) -> str:
    return _FAMILY.get(code.split("-")[0].lower(), code)


def features(texts: pa.Array) -> Iterator[np.ndarray | None]:
    """Of each text, or None if it has no letter."""
    buf, at = flat(texts)
    code = _CODE[buf]
    gram = np.zeros(len(buf), np.uint32)
    if len(buf) > 2:
        gram[1:-1] = code[:-2] << 12 | code[1:-1] << 6 | code[2:]
    place = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    alone = (code == 0) & (np.concatenate(([0], code[:-1])) == 0)  # runs of other signs count once at most
    letters = np.concatenate(([0], np.cumsum(_LETTER[buf])))
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if letters[a] == letters[b] and not any(c.isalpha() for c in texts[i].as_py() or ""):
            yield None
            continue
        inner = place[a + 1 : b - 1] if b - a > 2 else place[a:b]
        keep = ~alone[a + 1 : b - 1] if b - a > 2 else slice(None)
        x = np.sqrt(np.bincount(inner[keep], minlength=WIDTH).astype(np.float32))
        yield x / max(float(np.sqrt(x @ x)), 1e-9)


def machines(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 150) -> np.ndarray:
    """A column of weights (the last is the bias) for each column of y (1 and -1): linear SVMs with squared hinge loss, by
    accelerated gradient descent from zero; both sides count alike.
    """
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    up = y > 0
    share = (np.where(up, 0.5 / np.maximum(up.sum(axis=0), 1), 0.5 / np.maximum((~up).sum(axis=0), 1)) * y).astype(np.float32)
    w = v = np.zeros((x.shape[1], y.shape[1]), np.float32)
    step = np.float32(1 / (1 / c + 4.0))
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v)) * share
        new = v - step * (v / np.float32(c * 10) - 2 * (x.T @ slack))
        v = new + np.float32(i / (i + 3)) * (new - w)
        w = new
    return w


def _sides(of: np.ndarray, names: list[str]) -> np.ndarray:
    return np.where(of[:, None] == np.array(names)[None], 1, -1).astype(np.float32)


def fitted(x: np.ndarray, langs: list[str]) -> dict:
    """The model: names, a machine for each family (for two, one against the other), and one for each pair of languages of a family."""
    own = np.array(langs)
    names = sorted(set(langs))
    fam = np.array([family(c) for c in langs])
    families = sorted(set(fam.tolist()))
    languages = {f: [n for n in names if family(n) == f] for f in families}
    pairs = {
        f: {
            (a, b): machines(x[m], _sides(own[m], [a]))[:, 0] for a,
            b in combinations(languages[f], 2) for m in [(own == a) | (own == b)]
        } for f in families
    }
    told = machines(x, _sides(fam, families[: len(families) if len(families) > 2 else 1])) if len(families) > 1 else None
    return {"families": families, "family": told, "languages": languages, "language": pairs}


def vote(x: np.ndarray, names: list[str], duels: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of the name with most votes, ties to the larger sum of margins, and its least probability in its own duels."""
    votes, sums, least = (np.full((len(x), len(names)), v, np.float32) for v in (0, 0, 1))
    for (a, b), w in duels.items():
        i, j = names.index(a), names.index(b)
        m = x @ w[:-1] + w[-1]
        p = 1 / (1 + np.exp(-3 * m))
        votes[:, i] += m >= 0
        votes[:, j] += m < 0
        sums[:, i] += m
        sums[:, j] -= m
        least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
    best = np.argmax(votes + sums / (1 + np.abs(sums).max(initial=0)) / 2, axis=1)
    return best, least[np.arange(len(x)), best]


def first_of(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of the family of the largest margin, and its probability."""
    w = model["family"]
    if w is None:
        return np.zeros(len(x), int), np.ones(len(x), np.float32)
    m = x @ w[:-1] + w[-1]
    m = m if m.shape[1] > 1 else np.hstack((m, -m))
    best = np.argmax(m, axis=1)
    return best, 1 / (1 + np.exp(-3 * m[np.arange(len(x)), best]))


def told(model: dict, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    best, score = first_of(x, model)
    out = [""] * len(x)
    score = score.astype(np.float64)
    for f, name in enumerate(model["families"]):
        rows = np.flatnonzero(best == f)
        if not len(rows):
            continue
        langs = model["languages"][name]
        which, p = vote(x[rows], langs, model["language"][name])
        score[rows] *= p
        for r, k in zip(rows.tolist(), which.tolist(), strict=True):
            out[r] = langs[k]
    return out, score


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [None if x is None else x.astype(np.float16).tobytes() for x in features(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), part.column("_order"), pa.array(rows, pa.binary())], names=["lang", "_order", "x"]
            )


def fit(labelled: DataFrame, per_lang: int = 800, most_rows: int = 6000, seed: int = 5) -> dict | None:
    """A model from rows of `text`, `lang`; None if there are none.

    It is fitted on `most_rows` different texts at most, drawn by a hash of the text so that reruns agree: of each language
    `per_lang`, or fewer, alike for all, if there are so many languages. This bounds what reaches the driver. Copies of a text
    count once. Rows without text, language or letters teach nothing.
    """
    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), "text"))
    n = F.approx_count_distinct("_order", 0.05)
    counts = rows.groupBy("lang").agg(n.alias("n")).orderBy(F.desc("n"), "lang").limit(most_rows).collect()  # the bound leaves each language a row at least
    if not counts:
        return None
    per_lang = max(1, min(per_lang, most_rows // len(counts)))
    spark = labelled.sparkSession
    parts = spark.createDataFrame(
        [(r["lang"], min(1.0, (1.5 * per_lang + 60) / max(r["n"], 1)) * (1 << 30)) for r in counts],
        "lang string, _below double"
    )
    place = F.pmod("_order", F.lit(1 << 30))
    drawn = rows.join(F.broadcast(parts), "lang").where(
        (place < F.col("_below")) & F.col("text").rlike(r"\p{L}")
    ).select("text", "lang", "_order").dropDuplicates(["lang", "_order"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy(place, "_order"))
    got: dict[str, list] = {}
    for r in sorted(
        drawn.withColumn("_n", first).where(F.col("_n") <= per_lang).drop("_n").mapInArrow(
            _featured, "lang string, _order long, x binary"
        ).where("x IS NOT NULL").collect(),
        key=lambda r: (r["lang"], r["_order"])
    ):
        got.setdefault(r["lang"], []).append(np.frombuffer(r["x"], np.float16))
    if not got:
        return None
    x = np.stack([v for own in got.values() for v in own]).astype(np.float32)
    return fitted(x, [lang for lang, own in got.items() for _ in own])


def predict(df: DataFrame, model: dict | None) -> DataFrame:
    """df with `lang_pred` and `score` (0 to 1), in place of columns of these names. Null texts and texts without a letter, and all
    texts if there is no model, are `und` with score 0. All other columns of df are kept; it must have a `text`.
    """
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")))
    schema = df.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                own = list(features(part.column("text")))
                rows = [i for i, x in enumerate(own) if x is not None] if model else []
                lang, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if rows:
                    names, p = told(model, np.stack([own[i] for i in rows]))
                    score[rows] = p
                    for i, name in zip(rows, names, strict=True):
                        lang[i] = name
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score)],
                    names=[*part.schema.names, "lang_pred", "score"]
                )

    return df.mapInArrow(kernel, schema)


def held_out(df: DataFrame) -> DataFrame:
    """df with `held_out`: crc32 of doc_id as text is divisible by 5. Rows without a doc_id are not."""
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def identify(df: DataFrame, per_lang: int = 800) -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred`, `score`: the model learns from rows that aren't held out and predicts all."""
    rows = held_out(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")))
    model = fit(rows.where("NOT held_out AND doc_id IS NOT NULL"), per_lang)
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")

"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few_files, map_texts, ship

#: Most labelled rows that a model is fitted on, chosen by a hash of their id.
MOST_LABELLED = 12_000
THRESHOLD = 0.3
#: Rows of the base rate that each pool of the calibration is mixed with, so that few labels reject little.
CAUTION = 5

# Common insults of four languages, without slurs for groups of people.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool fools foolish loser losers pathetic worthless trash garbage "
    "scum scumbag clown clowns disgusting disgrace jerk jerks imbecile creep coward cowards liar liars ugly freak vermin rat pig filth filthy "
    "useless hopeless brainless braindead hate shut suck sucks crap damn hell asshole bastard bitch bullshit shit fuck fucking "
    "imbécile débile crétin connard salaud ordure merde dummkopf idioten trottel arschloch scheiße abschaum versager "
    "estúpido estúpida imbécil tonto basura inútil asqueroso mierda cabrón"
).split()
# Words that address a person.
SECOND_PERSON = "you your yours you're ur u yourself tu te toi vous votre du dich dir dein ihr euch usted ustedes tus".split()
# What obfuscation writes for a letter.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

_INSULT = frozenset(INSULTS)
_YOU = frozenset(SECOND_PERSON)
_EDGE = " \t.,;:!?\"'()[]{}<>#$%&*|~^_-+=/\\`"
_INNER = re.compile(r"(?<=[^\W_])[*.\-_~^|]+(?=[^\W_])")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]\x20){3,}[^\W\d_](?!\S)")

FEATURES = (
    "learned", "learned_rate", "learned_weight", "insults", "insult_rate", "distinct_insults", "densest", "disguised", "disguised_rate", "near_you", "you_rate", "capitals", "capital_words",
    "punctuation", "exclamations", "symbols", "mixed_words", "variety", "log_words",
)

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
for _c in b".,;:?'\"()-":
    _CLASS[_c] = 3
_CLASS[ord("!")] = 4
for _c in b"#$%&*@^~|<>=+_/\\{}[]":
    _CLASS[_c] = 5


Lexicon = dict[str, float]


def grams(bare: str) -> tuple[str, ...]:
    """What a word counts as in a learned lexicon: itself, and its longer prefixes."""
    return (bare,) if len(bare) < 5 else (bare, bare[:4] + "*", bare[:5] + "*")


def features(text: str, lexicon: Lexicon | None = None) -> list[float]:
    """Dense features of a whole text, in the order of FEATURES; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    lexicon = lexicon or {}
    words = text.lower().split()
    n, counts = max(1, len(words)), Counter(words)
    plain, disguised, mixed, learned, weight = [], 0, 0, 0, 0.0
    for w, c in counts.items():
        bare = w.strip(_EDGE)
        if lexicon and (known := max((lexicon[g] for g in grams(bare) if g in lexicon), default=0.0)):
            learned, weight = learned + c, weight + known
        if bare in _INSULT:
            plain.append((w, bare))
        elif not bare.isalpha() and bare:
            mixed += 1
            if _INNER.sub("", bare).translate(STAND_INS) in _INSULT or w.strip(".,;:?\"'()").translate(STAND_INS) in _INSULT:
                disguised += 1
                plain.append((w, bare))
    for m in _SPACED.finditer(text.lower()):
        if m[0].replace(" ", "") in _INSULT:
            disguised += 1
    at, near, densest, hits = [], 0, 0, {w for w, _ in plain}
    if hits:
        at = [i for i, w in enumerate(words) if w in hits]
        densest = int((np.searchsorted(at, np.asarray(at) + 40) - np.arange(len(at))).max())
    you = [i for i, w in enumerate(words) if w.strip(_EDGE) in _YOU] if hits else []
    if you:
        spots = np.asarray(you)
        k = np.searchsorted(spots, at)
        left = np.abs(spots[np.maximum(k - 1, 0)] - at)
        right = np.abs(spots[np.minimum(k, len(spots) - 1)] - at)
        near = int((np.minimum(left, right) <= 5).sum())
    data = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_CLASS[data], minlength=6)
    letters = max(1, int(kinds[1] + kinds[2]))
    size = len(data)
    return [
        float(np.log1p(learned)), learned / n, weight, float(np.log1p(len(at))), len(at) / n, float(len({b for _, b in plain})), float(densest), float(disguised), disguised / n, float(near), len(you) / n,
        kinds[1] / letters, float(text.isupper()), kinds[3] / size, kinds[4] / size, kinds[5] / size, mixed / n, len(counts) / n, float(np.log1p(n)),
    ]


FOLDS = 4


def learn_lexicons(sample: DataFrame, support: int = 4, ratio: float = 15.0, most: int = 4000) -> list[Lexicon]:
    """Words and prefixes far more frequent in toxic documents of a bounded labelled sample (text, toxic, fold).

    One lexicon without each fold, then one of all. Equal texts count once. A gram needs
    `support` toxic documents and `ratio` times the clean rate; the `most` heaviest, with their
    log ratio, make a lexicon.
    """

    def make():
        def of(rows: list[str]) -> dict[str, list]:
            n = Counter(g for t in rows for g in {g for w in set(t.lower().split()) for g in grams(w.strip(_EDGE))} if g)
            return {"gram": [list(n)] + [[]] * (len(rows) - 1), "n": [list(n.values())] + [[]] * (len(rows) - 1)}

        return of

    once = sample.groupBy("text").agg((F.max("toxic") > 0).alias("bad"), F.min("fold").alias("fold"))
    sizes = {(r[0], r[1]): r[2] for r in once.groupBy("bad", "fold").count().collect()}
    total = lambda bad, but: sum(n for (b, f), n in sizes.items() if b == bad and f != but)
    if not total(True, None) or not total(False, None):
        return [{}] * (FOLDS + 1)
    parts = None
    for bad, fold in sorted(sizes):
        rows = once.where((F.col("bad") == F.lit(bad)) & (F.col("fold") == fold)).select("text")
        part = map_texts(rows, make, "gram array<string>, n array<long>", 1024).select(F.lit(bad).alias("bad"), F.lit(fold).alias("fold"), F.explode(F.arrays_zip("gram", "n")).alias("x"))
        parts = part if parts is None else parts.unionByName(part)
    cells = [F.sum(F.when((F.col("bad") == F.lit(b)) & (F.col("fold") == f), F.col("x.n")).otherwise(0)).alias(f"{'bad' if b else 'good'}{f}") for b in (True, False) for f in range(FOLDS)]
    counts = parts.groupBy("x.gram").agg(*cells)
    bad, good = (sum(F.col(f"{k}{f}") for f in range(FOLDS)) for k in ("bad", "good"))
    weight = F.log((bad / total(True, None)) / ((good + 0.5) / total(False, None)))
    heavy = counts.where(bad >= support).withColumn("w", weight).where(F.col("w") >= float(np.log(ratio / 3))).orderBy(F.desc("w"), "gram").limit(4 * most).collect()
    out = []
    for but in [*range(FOLDS), None]:
        rates, n_bad, n_good = {}, max(1, total(True, but)), max(1, total(False, but))
        for r in heavy:
            b, g = (sum(r[f"{k}{f}"] for f in range(FOLDS) if f != but) for k in ("bad", "good"))
            if b >= support - (but is not None) and (w := float(np.log((b / n_bad) / ((g + 0.5) / n_good)))) >= np.log(ratio):
                rates[r["gram"]] = w
        out.append(dict(sorted(rates.items(), key=lambda x: (-x[1], x[0]))[:most]))
    return out


@dataclass
class Forest:
    """A learned lexicon, boosted trees as complete binary trees in arrays, and a calibration map."""

    lexicon: Lexicon = field(default_factory=dict)
    start: float = 0.0
    column: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    knots: np.ndarray = field(default_factory=lambda: np.array([-1.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for column, cut, leaf in zip(self.column, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range((len(column) + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[np.arange(len(x)), column[at]] > cut[at])
            out += leaf[at - len(column)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0) -> Forest:
    """Logistic boosting with histogram splits and second-order gains."""
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Forest(start=float(np.log(base / (1 - base))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    columns, inner = x.shape[1], (1 << depth) - 1
    flat = binned + np.arange(columns) * bins
    total = np.full(len(x), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        column, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            if len(own):
                cells = flat[own].ravel()
                gs = np.bincount(cells, np.repeat(g[own], columns), columns * bins).reshape(columns, bins).cumsum(1)
                hs = np.bincount(cells, np.repeat(h[own], columns), columns * bins).reshape(columns, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < least) | (ht - hs < least)] = 0
                best = int(gain.argmax())
                c, b = divmod(best, bins)
                if gain.flat[best] > 1e-6 and b < len(edges[c]):
                    column[node], cut[node] = c, edges[c][b]
            at[own] = 2 * node + 1 + (x[own, column[node]] > cut[node])
        gs, hs = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        leaf = rate * gs / (hs + 1)
        total += leaf[at - inner]
        model.column.append(column)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: middles of pools and their means, ascending, drawn to the base rate as by CAUTION rows."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, v in zip(raw[order], y[order], strict=True):
        pools.append([r, r, v, 1.0])
        while len(pools) > 1 and (pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3] or pools[-2][1] == pools[-1][0]):
            _, hi, v2, w2 = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + v2, pools[-1][3] + w2]
    knots = np.array([(p[0] + p[1]) / 2 for p in pools])
    levels = np.array([(p[2] + CAUTION * y.mean()) / (p[3] + CAUTION) for p in pools])
    levels = np.maximum.accumulate(levels)
    span = max(1.0, float(np.ptp(knots)))
    return np.r_[knots[0] - span, knots, knots[-1] + span], np.r_[levels[0] * 0.5, levels, (1 + levels[-1]) / 2]


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Forest:
    """A calibrated model; calibration sees only predictions of models that left the row out.

    Without rows every score is 0; with one class only, every score is near that class's rate.
    """
    if not len(y):
        return Forest()
    if len(np.unique(y)) < 2 or len(y) < 4 * FOLDS:
        p = float(np.clip(y.mean(), 0.01, 0.99))
        return Forest(knots=np.array([-1.0, 1.0]), levels=np.array([p, p]))
    apart = np.zeros(len(y))
    for k in np.unique(fold) if len(np.unique(fold)) > 1 else []:
        apart[fold == k] = boost(x[fold != k], y[fold != k]).raw(x[fold == k])
    model = boost(x, y)
    model.knots, model.levels = isotonic(apart, y)
    return model


def remainder(id_col: str):
    """crc32 of the id as text, mod 4."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4


def train(docs: DataFrame, labels: DataFrame, held_out: int = 2, most: int = MOST_LABELLED, id_col: str = "doc_id") -> Forest:
    """Fit on at most `most` labelled documents whose id has another remainder than held_out.

    Documents with several labels count as toxic if one says so; null ids and labels are left out.
    The chosen ids (at most `most`) are broadcast, so no other texts move. Lexicons are learned
    across folds of equal texts, so that no row is judged by words learned from itself.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("double").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (remainder("id") != held_out))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id", F.lit(3)), "id")
        .limit(most)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    sample = Scratch(docs.sparkSession, "toxic").keep(few_files(texts))
    *apart, lexicon = learn_lexicons(sample)
    rows = None
    for k in range(FOLDS):
        part = map_texts(sample.where(F.col("fold") == k), lambda k=k: _featurizer(apart[k]), "x array<double>")
        rows = part if rows is None else rows.unionByName(part)
    got = rows.groupBy("id").agg(F.min(F.struct("x", "toxic", "fold")).alias("r")).select("id", "r.*").orderBy("id").collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))
    model = fit(x, np.array([float(r["toxic"] > 0) for r in got]), np.array([r["fold"] for r in got], int))
    model.lexicon = lexicon
    return model


def _featurizer(lexicon: Lexicon):
    return lambda texts: {"x": [features(t, lexicon) for t in texts]}


def score(docs: DataFrame, model: Forest, name: str = "score") -> DataFrame:
    """All columns of docs and a column of scores; null texts count as empty."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded: trees and calibration knots

    def make():
        m = shared.value
        return lambda texts: {"score": m.score(np.array([features(t, m.lexicon) for t in texts]).reshape(-1, len(FEATURES))).tolist()}

    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return map_texts(whole, make, "score double").select("row.*", F.col("score").alias(name))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, held_out: int = 2, id_col: str = "doc_id") -> DataFrame:
    """id, held_out, score, predicted of every document, by a model fitted on labels that are not held out.

    Empty and null texts are scored too; a null id is not held out; repeated ids keep their rows.
    """
    model = train(docs, labels, held_out, id_col=id_col)
    rows = score(docs.select(F.col(id_col).alias("id"), "text"), model)
    return rows.select(
        F.col("id").alias(id_col), F.coalesce(remainder("id") == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    scored = score(docs, train(docs, labels), "__score")
    return scored.where(F.col("__score") < threshold).select(*docs.columns)

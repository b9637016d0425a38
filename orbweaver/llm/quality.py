"""Document quality by co-training two views.

One classifier sees the text only (its style, and words that tell the classes apart), the other the
page metadata only (source, language, length). Both start from the labelled rows. In each round each
view labels, of all rows without a label, the share of which it is surest in each class, and the other
view learns from them. A pseudo-label is the view's probability, not a class, and weighs as much as it
tells beyond the classes' shares, so that a view that knows little passes on little. In the end both are calibrated on labelled rows that took no part, and combined
there. One such pair is trained for each target: quality, and toxicity.

The features of all rows are made once and stored. A round is a few passes over them: histograms of both
views' scores say where the surest shares begin, and sums of gradients come back from each task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweaver.session import cut, drop_path, scratch_path

#: Bounds of the sample of labelled rows (chosen by a hash of the id), and of the words that a model looks at.
LABELLED, LEXICON = 12_000, 240
#: Rounds, gradient steps in each, the share of a class that a view passes on, and the weight of all that is
#: passed on, as a share of the labelled rows' weight.
ROUNDS, STEPS, SURE, PASSED = 3, 2, 0.25, 0.3
#: Bins of the scores' histograms, over scores from -REACH to REACH.
BINS, REACH = 512, 15.0
TARGETS = ("quality", "toxic")
WORD = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"[^\w\s.,;:!?'\"()\-]")
STYLE = 14


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def style(text: str | None) -> list[float]:
    """STYLE numbers that describe how a text is written; zeros for none."""
    text = text or ""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * STYLE
    chars, counts = len(text), Counter(tokens)
    letters = sum(map(len, WORD.findall(text))) or 1
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:]))  # noqa: B905
    distinct = sum(len(set(tokens[i : i + 400])) for i in range(0, n, 400))  # in windows: the share falls with the length
    return [
        1.0,
        math.log1p(n) / 10,
        sum(map(len, tokens)) / n / 10,
        upper / letters,
        min(2.0, len(ODD.findall(text)) / n),
        min(2.0, text.count("!") / n),
        min(2.0, text.count("|") / n),
        sum(map(str.isdigit, text)) / chars,
        repeats / n,
        counts.most_common(1)[0][1] / n,
        distinct / n,
        letters / chars,
        min(2.0, text.count("\n") / n),
        sum(w.isupper() and len(w) > 1 for w in tokens) / n,
    ]


META = 64


def metadata(lang: str | None, source: str | None, n_chars: float | None) -> list[int]:
    """Slots (of META) that the metadata of a page switch on."""
    n = 0 if n_chars is None or n_chars != n_chars else max(0, n_chars)
    return [zlib.crc32(f"s{source}".encode()) % 32, 32 + zlib.crc32(f"l{lang}".encode()) % 16, 48 + min(15, int(math.log2(n + 1)))]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 2.0, steps: int = 300) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    total = weight.sum()
    scale = 0.25 * float(np.linalg.norm(x, 2) ** 2) * weight.max() / total + ridge / total if len(x) < 3000 else 0.25 * float((x**2).sum(1).mean()) + ridge / total
    v, t = w.copy(), 1.0
    penalty = np.full(len(w), ridge / total)
    penalty[-1] = 0
    for _ in range(steps):
        g = x.T @ (weight * (sigmoid(x @ v) - y)) / total + penalty * v
        new = v - g / scale
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def apply_linear(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Views:
    """Weights of one target: text view, metadata view, and the calibrated combination of both."""

    text: np.ndarray
    meta: np.ndarray
    mixed: np.ndarray

    def scores(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text view, metadata view) probabilities."""
        a, b = np.clip(apply_linear(self.text, x), -15, 15), np.clip(apply_linear(self.meta, m), -15, 15)
        return sigmoid(apply_linear(self.mixed, np.stack([a, b], 1))), sigmoid(a), sigmoid(b)


def calibrated(text: np.ndarray, meta: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, own: np.ndarray) -> Views:
    """Both views, and their combination as learnt from the labelled rows that neither learnt from."""
    test = ~own if len(set(y[~own].tolist())) > 1 else np.ones(len(y), bool)
    z = np.stack([np.clip(apply_linear(text, x[test]), -REACH, REACH), np.clip(apply_linear(meta, m[test]), -REACH, REACH)], 1)
    return Views(text, meta, logistic(z, y[test], np.ones(int(test.sum())), ridge=0.5, steps=600))


class Pair:
    """The two views of one target while they are trained: views[0] by the text, views[1] by the metadata."""

    def __init__(self, x: np.ndarray, m: np.ndarray, y: np.ndarray, fold: np.ndarray, ridge: float = 2.0) -> None:
        self.x, self.m, self.y, self.own, self.ridge = x, m, y, fold > 0, ridge
        self.data = [np.hstack([a[self.own], np.ones((int(self.own.sum()), 1))]) for a in (x, m)]
        self.share = float(y[self.own].mean())
        self.views = [logistic(a[self.own], y[self.own], np.ones(int(self.own.sum())), ridge) for a in (x, m)]

    def edges(self, histograms: list[np.ndarray]) -> list[tuple[int, int]]:
        """For each view (last bin of its surest negatives, first bin of its surest positives)."""
        out = []
        for h in histograms:
            n = h.sum()
            low = int(np.searchsorted(np.cumsum(h), SURE * (1 - self.share) * n))
            high = len(h) - 1 - int(np.searchsorted(np.cumsum(h[::-1]), SURE * self.share * n))
            out.append((min(low, high - 1), max(high, low + 1)) if high <= low else (low, high))
        return out

    def step(self, k: int, gradient: np.ndarray, n: float) -> None:
        """One step of view k by its labelled rows and the summed gradient of ``n`` passed-on rows."""
        a, w, rows = self.data[k], self.views[k], len(self.data[k])
        p = sigmoid(a @ w)
        penalty = np.full(len(w), self.ridge)
        penalty[-1] = 1e-6
        weight = PASSED * rows / n if n else 0.0
        g = a.T @ (p - self.y[self.own]) + penalty * w * (np.arange(len(w)) < len(w) - 1) + weight * gradient
        curve = p * (1 - p) + (0.25 * PASSED if n else 0.0)  # of passed-on rows as much as there can be, so that no step goes too far
        h = (a * curve[:, None]).T @ a + np.diag(penalty) + 1e-3 * np.eye(len(w))
        self.views[k] = w - np.linalg.solve(h, g)


def _bins(z: np.ndarray) -> np.ndarray:
    return np.clip(((z + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1)


def histograms_of(views: list[np.ndarray], x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Counts of the scores of both views, one after the other."""
    return np.concatenate([np.bincount(_bins(apply_linear(w, a)), minlength=BINS) for w, a in zip(views, (x, m), strict=True)]).astype(np.float64)


def gradients_of(givers: list[np.ndarray], edges: list[tuple[int, int]], views: list[np.ndarray], share: float, x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What the surest rows of each giver add to the other view: (positives, negatives, gradient) of views 0 and 1.

    A row weighs as much as the giver's probability tells beyond the share of positives, 1 at most.
    """
    out = []
    for k, a in enumerate((x, m)):
        other = (x, m)[1 - k]
        z = np.clip(apply_linear(givers[1 - k], other), -REACH, REACH)
        b, (low, high) = _bins(z), edges[1 - k]
        sure = (b <= low) | (b >= high)
        a = a[sure]
        q = sigmoid(z[sure])
        r = np.minimum(1.0, (q - share) ** 2 / (share * (1 - share))) * (sigmoid(apply_linear(views[k], a)) - q)
        out += [np.array([(b >= high).sum(), (b <= low).sum()], np.float64), a.T @ r, np.array([r.sum()])]
    return np.concatenate(out)


@dataclass
class Model:
    """Words looked at (with their columns), and the views of each target; priors where a target has one class."""

    lexicon: dict[str, int]
    views: dict[str, Views | float]
    passed: list[tuple[str, int, str, int, int]] = field(default_factory=list)  # (target, round, giving view, positives, negatives)

    def features(self, text: str | None) -> tuple[list[float], list[int]]:
        found = {self.lexicon[w] for w in set(words(text)) & self.lexicon.keys()}
        return style(text), sorted(found)

    def matrix(self, rows: list[tuple[list[float], list[int]]]) -> np.ndarray:
        x = np.zeros((len(rows), STYLE + len(self.lexicon)), np.float64)
        for i, (s, found) in enumerate(rows):
            x[i, :STYLE] = s
            x[i, [STYLE + k for k in found]] = 1
        return x

    def decide(self, texts: list, langs: list, sources: list, sizes: list) -> tuple[np.ndarray, ...]:
        """(quality, toxic, quality by the text, quality by the metadata) of each row."""
        return self.scored(self.matrix([self.features(t) for t in texts]), meta_matrix(langs, sources, sizes))

    def scored(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same of rows of features."""
        quality, toxic = (v.scores(x, m) if isinstance(v := self.views[t], Views) else (np.full(len(x), v),) * 3 for t in TARGETS)
        return np.where(x[:, 0] == 0, 0.0, quality[0]), toxic[0], quality[1], quality[2]


def meta_matrix(langs: list, sources: list, sizes: list) -> np.ndarray:
    m = np.zeros((len(langs), META), np.float64)
    for i, row in enumerate(zip(langs, sources, sizes, strict=True)):
        m[i, metadata(*row)] = 1
    return m


def _part(id_col: str, salt: str, most: int, n: int):
    bound = min(1 << 30, int(most / max(1, n) * (1 << 30)))
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1 << 30)) < bound


_FIELDS = ("lang", "source", "n_chars")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kinds = {"lang": "string", "source": "string", "n_chars": "double"}
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in _FIELDS])


def _tell_words(sample: DataFrame, target: str, most: int) -> list[str]:
    """The words whose presence tells the classes of a target apart best, by the score of two shares."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        pos: Counter = Counter()
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                found = set(words(text))
                n.update(found)
                if y:
                    pos.update(found)
        keys = list(n)
        yield pd.DataFrame({"word": pd.Series(keys, dtype=object), "n": pd.Series([n[k] for k in keys], dtype="int64"), "pos": pd.Series([pos[k] for k in keys], dtype="int64")})

    rows = sample.filter(F.col(target).isNotNull()).select("text", (F.col(target) == 1).alias("y"))
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0))).first()
    if not n1 or n1 == n:
        return []
    c = rows.mapInPandas(count, "word string, n long, pos long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).filter("n >= 4")
    share = F.col("n") / n
    z = (F.col("pos") / n1 - (F.col("n") - F.col("pos")) / (n - n1)) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n1 + 1 / (n - n1)))
    return [r["word"] for r in c.select("word", z.alias("z")).filter("abs(z) > 3.5").orderBy(F.desc(F.abs("z")), "word").limit(most).collect()]


class _Features:
    """(id, style, found, slots) of all rows, made once and stored in the shared folder."""

    def __init__(self, plain: DataFrame, model: Model) -> None:
        kind = plain.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found = [model.features(t.as_py()) for t in part.column(1)]
                    slots = [metadata(*row) for row in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                    cols = [pa.array([s for s, _ in found], pa.list_(pa.float64())), pa.array([k for _, k in found], pa.list_(pa.int32())), pa.array(slots, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["id", "style", "found", "slots"])

        made = plain.mapInArrow(run, f"id {kind}, style array<double>, found array<int>, slots array<int>")
        self.spark, self.path, self.width = plain.sparkSession, scratch_path(plain.sparkSession, "features"), STYLE + len(model.lexicon)
        made.write.parquet(self.path)
        self.rows = self.spark.read.schema(made.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def _unpack(style: pa.Array, found: pa.Array, slots: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of both views' matrices."""
    n = len(style)
    x, m = np.zeros((n, width)), np.zeros((n, META))
    for a, out, at in ((found, x, STYLE), (slots, m, 0)):
        sizes = np.diff(a.offsets.to_numpy()) if n else np.zeros(0, np.int64)
        out[np.repeat(np.arange(n), sizes), at + a.flatten().to_numpy(zero_copy_only=False)] = 1
    x[:, :STYLE] = style.flatten().to_numpy(zero_copy_only=False).reshape(n, STYLE)
    return x, m


def _summed(rows: DataFrame, width: int, of, size: int) -> np.ndarray:
    """The sum over all rows of the vector ``of(x, m)``; tasks send one vector each, and these meet in a few tasks first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                total += of(*_unpack(*(batch.column(i).slice(at, 4096) for i in range(3)), width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(batch.num_rows, size).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    sums = rows.select("style", "found", "slots").mapInArrow(part, "v array<double>")
    few = max(1, round(rows.rdd.getNumPartitions() ** 0.5))
    return np.sum([r["v"] for r in sums.repartition(few).mapInArrow(add, "v array<double>").collect()] or [np.zeros(size)], axis=0)


def _exchange(pairs: dict[str, Pair], pool: DataFrame, width: int, rounds: int) -> list[tuple[str, int, str, int, int]]:
    """Rounds of passing on the surest rows of each view to the other; what was passed on."""
    names, log = list(pairs), []
    size, shares = 2 * BINS, {t: p.share for t, p in pairs.items()}
    for round_ in range(rounds if names else 0):
        givers = {t: [w.copy() for w in pairs[t].views] for t in names}
        counts = _summed(pool, width, lambda x, m, g=givers: np.concatenate([histograms_of(g[t], x, m) for t in names]), size * len(names))
        if not counts.any():
            break
        edges = {t: pairs[t].edges([counts[i * size + k * BINS :][:BINS] for k in (0, 1)]) for i, t in enumerate(names)}
        for step in range(STEPS):
            views = {t: [w.copy() for w in pairs[t].views] for t in names}
            sizes = [2 + len(w) for w in views[names[0]]]
            sums = _summed(pool, width, lambda x, m, g=givers, e=edges, v=views: np.concatenate([gradients_of(g[t], e[t], v[t], shares[t], x, m) for t in names]), sum(sizes) * len(names))
            at = 0
            for t in names:
                for k, n in enumerate(sizes):
                    positives, negatives, gradient = int(sums[at]), int(sums[at + 1]), sums[at + 2 : at + n]
                    pairs[t].step(k, gradient, positives + negatives)
                    if not step:
                        log.append((t, round_, ("metadata", "text")[k], positives, negatives))
                    at += n
    return log


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Train on at most about LABELLED labelled rows, chosen by a hash of the id, and on all rows without a label.

    Rows of any label take no part in the exchange, nor do texts without words. Of several labels of
    one document the largest counts. A target without two classes gets its share as a constant score
    (without labels: quality 1, toxic 0, which keeps everything).
    """
    model, features = _fit(docs, labels, id_col, text_col, rounds)
    features.drop()
    return model


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rounds: int) -> tuple[Model, _Features]:
    plain = _plain(docs, id_col, text_col)
    lab = cut(labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(t).alias(t) for t in TARGETS]))
    some = lab.filter(_part("id", "labelled", LABELLED, lab.count()))
    sample = cut(plain.join(F.broadcast(some), "id"))  # about LABELLED rows
    lexicon = {w: i for i, w in enumerate(dict.fromkeys(w for t in TARGETS for w in _tell_words(sample, t, LEXICON // 2)))}
    model = Model(lexicon, {})

    def rows_of(df: DataFrame, extra: list[str]) -> pd.DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                f = [model.features(t) for t in pdf["text"]]
                yield pd.DataFrame({"id": pdf["id"], "style": [s for s, _ in f], "found": [k for _, k in f], **{c: pdf[c] for c in (*_FIELDS, *extra)}})

        schema = "id long, style array<double>, found array<int>, lang string, source string, n_chars double" + "".join(f", {c} int" for c in extra)
        return df.withColumn("id", F.col("id").cast("long")).mapInPandas(run, schema).toPandas().sort_values("id", kind="stable")

    own = rows_of(sample.select("id", "text", *_FIELDS, *[F.col(t).cast("int").alias(t) for t in TARGETS]), list(TARGETS))
    none = lambda s: [None if pd.isna(v) else v for v in s]
    x = model.matrix(list(zip(own["style"], own["found"], strict=True)))
    m = meta_matrix(none(own["lang"]), none(own["source"]), none(own["n_chars"]))
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in own["id"]], np.int64)
    pairs, known = {}, {}
    for t, default in zip(TARGETS, (1.0, 0.0), strict=True):
        ok = own[t].notna().to_numpy() if len(own) else np.zeros(0, bool)
        y = own[t][ok].to_numpy(np.float64) if len(own) else np.zeros(0)
        y = (y == 1).astype(np.float64)
        if len(set(y[fold[ok] > 0].tolist())) < 2:
            model.views[t] = float(y.mean()) if len(y) else default
        else:
            pairs[t], known[t] = Pair(x[ok], m[ok], y, fold[ok]), ok
    features = _Features(plain, model)
    if pairs and rounds:
        pool = features.rows.join(lab.select("id"), "id", "left_anti").filter(F.col("style")[0] > 0)
        model.passed = _exchange(pairs, cut(pool), features.width, rounds)
    for t, p in pairs.items():
        model.views[t] = calibrated(*p.views, p.x, p.m, p.y, p.own)
    return model, features


_SCORES = ("quality_score", "toxic_score", "text_score", "meta_score")


def _kept(scores: DataFrame) -> DataFrame:
    return scores.withColumn("keep", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, quality_score, toxic_score, text_score, meta_score, keep.

    text_score and meta_score are the two views' quality. keep: quality_score is 0.5 or more and
    toxic_score less. A text without words has quality_score 0 and is not kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON

    @F.pandas_udf(", ".join(f"{c} double" for c in _SCORES))
    def of(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        mdl = shared.value
        none = lambda s: [None if pd.isna(v) else v for v in s]
        return pd.DataFrame(dict(zip(_SCORES, mdl.decide(none(text), none(lang), none(source), none(n_chars)), strict=True)))

    plain = _plain(docs, id_col, text_col)
    return _kept(plain.select("id", of("text", *_FIELDS).alias("s")).select(F.col("id").alias(id_col), "s.*"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Fit on the labelled rows and those without a label, and score every document; see fit and score.

    Null metadata is a value of its own; texts of any length are read whole; repeated rows stay; columns
    of other names do no harm; an empty table of documents has no rows.
    """
    model, features = _fit(docs, labels, id_col, text_col, rounds)
    shared, width = docs.sparkSession.sparkContext.broadcast(model), features.width  # bounded by LEXICON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                scores = shared.value.scored(*_unpack(*(part.column(i) for i in (1, 2, 3)), width))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, scores)], [id_col, *_SCORES])

    kind = features.rows.schema["id"].dataType.simpleString()
    try:
        return cut(_kept(features.rows.mapInArrow(run, f"`{id_col}` {kind}" + "".join(f", {c} double" for c in _SCORES))))
    finally:
        features.drop()


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns and nothing else."""
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        mdl = shared.value
        none = lambda s: [None if pd.isna(v) else v for v in s]
        quality, toxic, *_ = mdl.decide(none(text), none(lang), none(source), none(n_chars))
        return pd.Series((quality >= 0.5) & (toxic < 0.5))

    fields = [(F.col(c) if c in docs.columns else F.lit(None)).cast({"lang": "string", "source": "string", "n_chars": "double"}[c]) for c in _FIELDS]
    return docs.filter(good(F.col(text_col), *fields))

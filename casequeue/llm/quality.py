"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees which words occur and how the text is made (shares of capitals, marks, digits,
repeated words and lines, lengths); the metadata view sees source, language and recorded length.
A view's model weighs a feature by the log ratio of its rates under both values, times a coefficient
from a logistic fit on labelled documents. In each of ``ROUNDS`` rounds both views score every
unlabelled document, and each labels all of which it is sure for the other view to train on. Those
come back as counts of documents by feature and value, and the other view is trained anew: ratios are
those of labelled and pseudo-labelled documents together, and coefficients and bias are fitted again
on them. A sure teacher can be wrong in the same way again and again, so the pseudo-labelled documents of a
value weigh at most ``MASSES`` times its labelled ones; the view keeps the mass with the least loss on labelled
documents that it has not seen. Features that labelled rows hardly have get the ratio of all pseudo-labelled
documents, whatever the mass, and the mean coefficient. A logistic model over both views' log-odds, fitted on
the labelled documents that neither has seen, calibrates and combines them. The same is done for each
target: ``quality`` and ``toxic``.

At most ``LABELLED`` labelled rows, chosen by a hash of the id, are fitted on the driver, one document
of each id. Features of all documents are written once, so a round reads no text. Every document is
scored, on its whole text.

Null texts count as empty; null metadata is a value of its own. Repeated rows are scored one by one.
A target whose labels lack one of the two values gets its observed rate as score; without any label
quality is 1 and toxicity 0. Labels of null ids or without a value are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequeue.llm.common import bound_batches, fresh, handed_over, keep_only, worker_cache

LABELLED = 12_000
ROUNDS = 3
SURE = 0.95
MIN_DOCUMENTS = 3  # of the training set, for a feature to count
WORD_BITS = 18
SHAPES = 256
FEATURES = (1 << WORD_BITS) + SHAPES
META_FEATURES = 1 << 12
MASSES = (0.0, 0.03, 0.3, 1.0)  # of pseudo-labelled documents, by value, to labelled ones
LEAST_RATIO = 1.0  # log ratio of its rates under both values, for a feature to count
SHAPE_SCALE = 4.0  # a long text has many words but one value of each shape
HEAD = 4
CACHE_WORDS = 150_000
ODDS = 15.0  # bound of a view's log-odds where views combine
TARGETS = {"quality": 1.0, "toxic": 0.0}  # with the score where nothing is labelled

_KINDS = np.zeros(256, np.int64)  # of bytes: 0 rest, 1 capital, 2 small, 3 digit, 4 space, 5 mark
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[[9, 10, 13, 32]] = 1, 2, 3, 4
_KINDS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 5
_SHAPES = "capitals digits marks other marked again most repeated length word lines".split()
_LEVELS = {
    name: tuple((1 << WORD_BITS) + 16 * i + level for level in range(11))
    for i, name in enumerate(_SHAPES)
}
_STRIP = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())


class _Words(dict):
    """Feature numbers of a word: of itself without marks, and of its first letters."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > CACHE_WORDS:
            self.clear()
        bare = word.strip(_STRIP).lower() or word
        head = f"{bare[:HEAD]}-" if len(bare) > HEAD else bare
        found = self[word] = tuple(
            zlib.crc32(x.encode("utf-8", "replace")) >> (32 - WORD_BITS) for x in (bare, head)
        )
        return found


_WORDS = worker_cache(_Words())


def _shape(name: str, value: float, steps: int = 10) -> tuple[int, ...]:
    """Numbers of all levels up to that of a share from 0 to 1, so that neighbours have most alike."""
    return _LEVELS[name][: min(steps, int(value * steps)) + 1]


def text_features(text: str, words: dict) -> np.ndarray:
    """Distinct feature numbers of a whole text."""
    parts = text.split()
    n = max(1, len(parts))
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(_KINDS[raw], minlength=6) / max(1, len(raw))
    distinct = set(parts)
    lines = text.split("\n")
    again = sum(a == b for a, b in zip(parts, parts[1:], strict=False))
    most = Counter(parts).most_common(1)[0][1] if parts else 0
    marked = sum(1 for w in distinct if not w[-1].isalnum()) / max(1, len(distinct))
    shapes = {
        "capitals": kinds[1] / max(1e-9, kinds[1] + kinds[2]),
        "digits": kinds[3],
        "marks": kinds[5],
        "other": kinds[0],
        "marked": marked,
        "again": again / n,
        "most": most / n,
        "repeated": 1 - len(distinct) / n,
        "length": np.log2(n) / 20,
        "word": min(1.0, len(text) / n / 40),
        "lines": 1 - len(set(lines)) / len(lines),
    }
    levels = chain.from_iterable(_shape(k, v) for k, v in shapes.items())
    return np.fromiter(set(levels).union(*map(words.__getitem__, distinct)), np.int32)


def metadata_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = -1 if n_chars is None or n_chars < 0 else int(n_chars).bit_length()
    named = {f"source={source}", f"lang={lang}", f"size={size}", f"lang={lang},size={size}"}
    return np.array(sorted({zlib.crc32(x.encode()) % META_FEATURES for x in named}), np.int32)


@dataclass
class Rows:
    """Binary features of documents, one after another."""

    index: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, features: list[np.ndarray]) -> Rows:
        index = np.concatenate([np.zeros(0, np.int32), *features])
        return cls(index, np.array([len(f) for f in features], np.int64))

    def take(self, at: np.ndarray) -> Rows:
        ends = np.cumsum(self.counts)
        starts = ends - self.counts
        return Rows.of([self.index[starts[i] : ends[i]] for i in at])

    @classmethod
    def unpacked(cls, column: list[bytes]) -> Rows:
        """Rows of ``_packed_features``."""
        return cls.of([np.cumsum(np.frombuffer(b, np.int32), dtype=np.int32) for b in column])

    def held_by(self, documents: np.ndarray, size: int) -> np.ndarray:
        """Number of the marked documents that have each feature."""
        return np.bincount(self.index[np.repeat(documents, self.counts)], minlength=size)

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        return np.bincount(owner, weights[self.index], len(self.counts)) + bias


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Taught:
    """Documents that the other view labelled: how many of each value have a feature, and in all."""

    low: np.ndarray
    high: np.ndarray
    zeros: int
    ones: int


def fit_logistic(
    rows: Rows,
    y: np.ndarray,
    size: int,
    taught: Taught | None = None,
    mass: float = 0.0,
    steps: int = 80,
    l2: float = 1e-5,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over binary features, by full-batch AdaGrad.

    A feature is scaled by its log ratio of rates under both values, so that a word which tells the
    values apart learns faster than the many that do not. The documents of a value in ``taught`` count in the
    ratios, as at most ``mass`` times its rows. Features of fewer than ``MIN_DOCUMENTS`` rows have the ratio of all
    of ``taught``, if any, and the mean coefficient of the others.
    """
    every, ones = np.bincount(rows.index, minlength=size), y.sum()
    high, zeros = rows.held_by(y > 0, size), len(y) - ones
    if taught is None:
        taught = Taught(np.zeros(size), np.zeros(size), 0, 0)
    by_ones = min(1.0, mass * ones / max(1, taught.ones))
    by_zeros = min(1.0, mass * zeros / max(1, taught.zeros))
    ratio = np.log((high + by_ones * taught.high + 1) / (ones + by_ones * taught.ones + 2)) - np.log(
        (every - high + by_zeros * taught.low + 1) / (zeros + by_zeros * taught.zeros + 2)
    )
    telling = (every >= MIN_DOCUMENTS) & (np.abs(ratio) >= LEAST_RATIO)
    kept, names = telling[rows.index], np.flatnonzero(telling)
    owner = np.repeat(np.arange(len(rows.counts), dtype=np.int32), rows.counts)
    owner, index = owner[kept], (np.cumsum(telling, dtype=np.int32) - 1)[rows.index[kept]]
    ratio = ratio[telling]
    scale = np.where(names >= 1 << WORD_BITS, SHAPE_SCALE, 1.0) * ratio
    v, squares, n = np.zeros(len(names)), np.full(len(names), 1e-8), len(y)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias, bias_square = np.log(rate / (1 - rate)), 1e-8
    for _ in range(steps):
        error = _sigmoid(np.bincount(owner, (v * scale)[index], n) + bias) - y
        g = scale * np.bincount(index, error[owner], len(names)) / n + l2 * v
        squares += g * g
        v -= 0.1 * g / np.sqrt(squares)
        b = error.mean()
        bias_square += b * b
        bias -= 0.1 * b / np.sqrt(bias_square)
    weights = np.zeros(size)
    weights[names] = v * scale
    if taught.ones + taught.zeros and len(names):
        ones, zeros = taught.ones + ones, taught.zeros + zeros
        share = ones / (ones + zeros)  # a rare feature has a ratio near 0 however unequal the values
        low, high = every - high + taught.low, high + taught.high
        ratio = np.log((high + 2 * share) / ones) - np.log((low + 2 * (1 - share)) / zeros)
        new = (every < MIN_DOCUMENTS) & (high + low >= MIN_DOCUMENTS) & (np.abs(ratio) >= LEAST_RATIO)
        weights[new] = v.mean() * ratio[new]
    return weights, float(bias)


def _fit_combined(views: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bias and one weight for each view's log-odds: Newton steps, halved until the loss falls.

    A ridge draws the weights towards plain trust in both views.
    """
    x = np.column_stack([np.ones(len(y)), np.clip(views, -ODDS, ODDS)])
    start = np.array([0.0] + [1.0] * views.shape[1])

    def loss(w):
        z = x @ w
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum((w - start) ** 2)

    w = start.copy()
    for _ in range(25):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step, size = np.linalg.solve(h, x.T @ (p - y) + (w - start)), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w


_SIZES = (FEATURES, META_FEATURES)


class _Learner:
    """Both views of one target, over its labelled rows; every fifth is kept for the combination."""

    def __init__(self, text: Rows, meta: Rows, y: np.ndarray):
        held = np.arange(len(y)) % 5 == 0
        if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
            held = np.zeros(len(y), bool)
        train = np.flatnonzero(~held)
        judge = np.flatnonzero(held) if held.any() else train
        self.y, self.judged = y[train].astype(float), y[judge].astype(float)
        self.rows = [r.take(train) for r in (text, meta)]
        self.judges = [r.take(judge) for r in (text, meta)]
        self.learn((None, None))

    def learn(self, taught: tuple) -> None:
        self.models = [self._best(view, lesson) for view, lesson in enumerate(taught)]

    def _best(self, view: int, lesson: Taught | None) -> tuple[np.ndarray, float]:
        """The model of the mass that fits the unseen labelled rows best; the least mass of equal ones."""
        rows, size = self.rows[view], _SIZES[view]
        if lesson is None:
            return fit_logistic(rows, self.y, size)

        def loss(model):
            odds = np.clip(self.judges[view].scores(*model), -ODDS, ODDS)
            return float(np.sum(np.logaddexp(0, odds) - self.judged * odds))

        return min((fit_logistic(rows, self.y, size, lesson, mass) for mass in MASSES), key=loss)

    def model(self) -> dict:
        odds = [r.scores(*m) for r, m in zip(self.judges, self.models, strict=True)]
        return {"views": self.models, "combined": _fit_combined(np.column_stack(odds), self.judged)}


def _packed_features(found: np.ndarray) -> bytes:
    """Steps between sorted feature numbers, which compress well."""
    return np.diff(np.sort(found), prepend=np.int32(0)).astype(np.int32).tobytes()


def _featured(batches):
    words = _WORDS
    keep_only(words)
    for batch in batches:
        columns = batch.to_pydict()
        rows = zip(columns["text"], columns["source"], columns["lang"], columns["n_chars"], strict=True)
        text, meta = [], []
        for t, s, g, n in rows:
            text.append(_packed_features(text_features(t or "", words)))
            meta.append(_packed_features(metadata_features(s, g, n)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("i"), pa.array(text, pa.binary()), pa.array(meta, pa.binary())],
            names=["i", "text", "meta"],
        )


def _dense(models: dict) -> dict:
    """Both views of packed models with an array of all weights."""
    dense = {}
    for target, model in models.items():
        if "views" in model:
            dense[target] = []
            for (at, w, bias), size in zip(model["views"], _SIZES, strict=True):
                full = np.zeros(size, np.float32)
                full[at] = w
                dense[target].append((full, bias))
    return dense


COUNTS = [f"{t}_{v}" for t in TARGETS for v in ("low", "high")]


def _teaching(packed: dict):
    """Counts of the documents that each view is sure of, by feature of the other; feature -1 is all."""

    def run(batches):
        dense = _dense(packed)
        # By the view that learns.
        found = [{c: np.zeros(size + 1, np.int64) for c in COUNTS} for size in _SIZES]
        for batch in batches:
            views = [Rows.unpacked(batch.column(c).to_pylist()) for c in ("text", "meta")]
            for target, models in dense.items():
                for teacher in (0, 1):
                    p = _sigmoid(views[teacher].scores(*models[teacher]))
                    learner, size = 1 - teacher, _SIZES[1 - teacher]
                    for value, sure in (("low", p <= 1 - SURE), ("high", p >= SURE)):
                        counts = found[learner][f"{target}_{value}"]
                        counts[:size] += views[learner].held_by(sure, size)
                        counts[size] += sure.sum()
        for view, size in enumerate(_SIZES):
            some = np.flatnonzero(np.sum([found[view][c] for c in COUNTS], axis=0))
            names = np.where(some == size, -1, some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), view, np.int32)), pa.array(names.astype(np.int32))]
                + [pa.array(found[view][c][some]) for c in COUNTS],
                names=["view", "feature", *COUNTS],
            )

    return run


def _lessons(pool: DataFrame, learners: dict) -> dict:
    """For each target what each view learns from all documents of ``pool``."""
    packed = {t: _packed({"views": x.models, "combined": None}) for t, x in learners.items()}
    schema = "view int, feature int, " + ", ".join(f"{c} long" for c in COUNTS)
    counted = pool.select("text", "meta").mapInArrow(_teaching(packed), schema)
    sums = counted.groupBy("view", "feature").agg(*(F.sum(c).alias(c) for c in COUNTS))
    rows = sums.toArrow()  # at most one row for each feature number
    view, feature = (rows.column(c).to_numpy() for c in ("view", "feature"))
    lessons = {}
    for target in learners:
        lessons[target] = []
        for at, size in enumerate(_SIZES):
            counts = []
            for value in ("low", "high"):
                every = np.zeros(size + 1, np.int64)
                every[feature[view == at]] = rows.column(f"{target}_{value}").to_numpy()[view == at]
                counts.append(every)
            low, high = counts
            lessons[target].append(Taught(low[:size], high[:size], int(low[size]), int(high[size])))
    return lessons


def _metadata(docs: DataFrame) -> list:
    """The metadata columns, null where ``docs`` lacks one."""
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    return [
        (docs[c] if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()
    ]


def _written_features(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``i``, both views' features and ``known``, whether the id is labelled, of each row of ``docs``."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), "text", *_metadata(docs))
    features = texts.mapInArrow(_featured, "i long, text binary, meta binary")
    # Merged at every size, so that features are moved once and in the same way whatever the labels' size.
    flagged = ids.withColumn("known", F.lit(True)).hint("merge")
    return handed_over(features.join(flagged, "i", "left"))


def fit(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED) -> dict:
    """A model for each target, from a bounded sample of labelled rows and all unlabelled documents."""
    return _fit(docs, labels, labelled)[0]


def _fit(docs: DataFrame, labels: DataFrame, labelled: int) -> tuple[dict, DataFrame]:
    """Models and the features of all documents."""
    known = labels.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("i"),
        F.col("quality").cast("int").alias("quality"),
        F.col("toxic").cast("int").alias("toxic"),
    )
    ids = known.where("quality is not null or toxic is not null").select("i").distinct()
    chosen = known.join(docs.select(F.col("doc_id").cast("long").alias("i")), "i", "left_semi")
    # At most ``labelled`` rows.
    chosen = chosen.orderBy(F.xxhash64("i"), "quality", "toxic").limit(labelled).collect()
    chosen = docs.sparkSession.createDataFrame(chosen, "i long, quality int, toxic int")
    features = _written_features(docs, ids)
    firsts = (
        features.where("known")
        .join(F.broadcast(chosen.select("i").distinct()), "i", "left_semi")
        .groupBy("i")
        .agg(F.min(F.struct("text", "meta")).alias("f"))
    )
    rows = firsts.join(F.broadcast(chosen), "i").select("quality", "toxic", "f.text", "f.meta").collect()
    rows.sort(key=lambda r: (zlib.crc32(r["text"]), r["text"], r["meta"]))
    text, meta = (Rows.unpacked([r[c] for r in rows]) for c in ("text", "meta"))
    rows = [{t: r[t] for t in TARGETS} for r in rows]  # the features are held once
    models, learners = {}, {}
    for target, neutral in TARGETS.items():
        at = np.flatnonzero([r[target] is not None for r in rows])
        y = np.array([rows[i][target] for i in at], float)
        if len(y) < 10 or y.min() == y.max():
            models[target] = {"rate": float(y.mean()) if len(y) else neutral}
        else:
            learners[target] = _Learner(text.take(at), meta.take(at), y)
    del text, meta  # each learner has its own
    pool = features.where("known is null")
    for _ in range(ROUNDS if learners else 0):
        for target, taught in _lessons(pool, learners).items():
            learners[target].learn(taught)
    models |= {target: learner.model() for target, learner in learners.items()}
    return {target: models[target] for target in TARGETS}, features


def _packed(model: dict) -> dict:
    """A model with its non-zero weights alone, to be sent to tasks."""
    if "rate" in model:
        return model
    views = []
    for weights, bias in model["views"]:
        at = np.flatnonzero(weights)
        views.append((at.astype(np.int32), weights[at].astype(np.float32), bias))
    return {"views": views, "combined": model["combined"]}


def _probabilities(models: dict, dense: dict, odds) -> dict[str, np.ndarray]:
    """The columns of scores from ``odds(view, weights, bias)``, log-odds of all rows."""
    found = {}
    for target, model in models.items():
        if target in dense:
            views = [odds(view, *dense[target][view]) for view in (0, 1)]
            c = model["combined"]
            both = c[0] + np.clip(np.column_stack(views), -ODDS, ODDS) @ c[1:]
            scores = (_sigmoid(both), _sigmoid(views[0]), _sigmoid(views[1]))
        else:
            scores = (None,) * 3
        for name, p in zip(("score", "text_score", "metadata_score"), scores, strict=True):
            found[f"{target}_{name}"] = p if p is not None else model["rate"]
    return found


def _scored_features(models: dict):
    """Scores of rows from their written features."""

    def run(batches):
        dense = _dense(models)
        for batch in batches:
            views = [Rows.unpacked(batch.column(c).to_pylist()) for c in ("text", "meta")]
            found = _probabilities(models, dense, lambda v, w, b, views=views: views[v].scores(w, b))
            scored = [pa.array(np.broadcast_to(found[s], batch.num_rows).astype(float)) for s in SCORES]
            yield pa.RecordBatch.from_arrays([batch.column("i"), *scored], names=["doc_id", *SCORES])

    return run


def _scored(models: dict):
    """Scores of rows from their texts and metadata."""

    def run(batches):
        words, dense = _WORDS, _dense(models)
        keep_only(words)
        for batch in batches:
            columns = batch.to_pydict()
            rows = zip(columns["text"], columns["source"], columns["lang"], columns["n_chars"], strict=True)
            views = [(text_features(t or "", words), metadata_features(s, g, n)) for t, s, g, n in rows]

            def odds(view, w, b, views=views):
                return np.array([float(w[v[view]].sum(dtype=np.float64)) + b for v in views])

            found = _probabilities(models, dense, odds)
            scored = [pa.array(np.broadcast_to(found[s], batch.num_rows).astype(float)) for s in SCORES]
            kept = batch.drop_columns(["text", "source", "lang", "n_chars"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, *scored], names=[*kept.schema.names, *SCORES]
            )

    return run


SCORES = [f"{t}_{v}" for t in TARGETS for v in ("score", "text_score", "metadata_score")]


_SCORED = "doc_id long, " + ", ".join(f"{s} double" for s in SCORES)


def _with_keep(scored: DataFrame) -> DataFrame:
    keep = (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)
    return scored.withColumn("keep", keep)


def score_documents(docs: DataFrame, models: dict) -> DataFrame:
    """``doc_id``, the scores of each target and view, and ``keep``: good enough and not toxic."""
    bound_batches(docs.sparkSession)
    packed = {t: _packed(m) for t, m in models.items()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_metadata(docs))
    return _with_keep(rows.mapInArrow(_scored(packed), _SCORED))


def fit_and_score(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED) -> DataFrame:
    """The scores of ``docs`` by models fitted on them; every text is read once."""
    models, features = _fit(docs, labels, labelled)
    packed = {t: _packed(m) for t, m in models.items()}
    return _with_keep(features.mapInArrow(_scored_features(packed), _SCORED))


def _judged(models: dict, columns: list[str], at: dict[str, str]):
    """Rows of batches that the models keep; ``at`` names the classifier's columns."""
    score = _scored(models)

    def run(batches):
        for batch in batches:
            inputs = [batch.column(at[c]) for c in ("text", "source", "lang", "n_chars")]
            order = pa.array(range(batch.num_rows), pa.int64())
            rows = pa.RecordBatch.from_arrays(
                [order, *inputs], names=["n", "text", "source", "lang", "n_chars"]
            )
            for found in score(iter([rows])):
                q = found.column(found.schema.names.index("quality_score")).to_numpy()
                t = found.column(found.schema.names.index("toxic_score")).to_numpy()
                yield batch.select(columns).filter(pa.array((q >= 0.5) & (t < 0.5)))

    return run


def kept_documents(docs: DataFrame, models: dict) -> DataFrame:
    """The rows of ``docs`` that are good enough and not toxic, with their columns; nothing moves."""
    bound_batches(docs.sparkSession)
    packed = {t: _packed(m) for t, m in models.items()}
    wanted = ("source", "lang", "n_chars")
    at = dict(zip(wanted, fresh(docs, *(f"for_{c}" for c in wanted)), strict=True))
    metadata = (c.alias(at[n]) for n, c in zip(wanted, _metadata(docs), strict=True))
    inputs = docs.select("*", *metadata)
    at["text"] = next(c for c in docs.columns if c.lower() == "text")  # texts are sent once
    return inputs.mapInArrow(_judged(packed, docs.columns, at), docs.schema)

"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: the code point n-grams (n in ``ORDERS``) of the lower-cased text between two blanks, hashed
  to 2**``BITS`` buckets; weight: share of the text's n-grams times inverse document frequency, which
  is counted over every training document.
* Languages: all of the training documents.  A state takes 2**``BITS`` * 16 bytes for each language in a training task and in
  the driver, which sees only the averaged one.
* Training: every labelled training document (``max_train`` draws a smaller set, equal for each language); follow the
  regularised leader with elastic-net penalties, ``EPOCHS`` rounds.  N-grams are counted once and kept packed, in shares of about
  ``SHARE_ROWS`` documents, ``WORKERS`` shares at least.  In a round each share is gone over from the common state, in an order
  that hangs on the id, whatever the layout of the table; the states are averaged in tasks, by ``SLICE`` buckets.
* Calibration: one temperature for all classes, which minimises the log loss of the fifth of all training documents
  that training did not see.
* Acceptance: a document is rejected if its score lies nearer to chance (one over the number of languages) than to the
  score that all but a thousandth of the calibration rows reach (to one part in ``STEPS``).

Training rows are those whose crc32 of the id's text, modulo ``folds``, is not ``held_out``; language,
source and id are never inputs of a prediction.

Edge cases: null text and text without a letter are ``und`` with score 0; so is every text if nothing can
be learned; rows with null language or null id are predicted, not learned from; ties go to the first
language by code point; repeated rows give repeated results; an empty table gives an empty result; texts of any
length are taken whole; other columns are ignored by the prediction and kept by ``accepted``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.shared import drop_stored, scratch
from headway.llm.textvec import chunks

BITS = 15
ORDERS = (1, 2, 3)
WORKERS = 6
LEAST_ROWS = 50
EPOCHS = 3
SHARE_ROWS = 16_000
BLOCK = 512
STEPS = 1 << 16
SLICE = 1024
SCALE = 12.0
_CHUNK = 500_000


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order the bucket of the n-gram that begins at each position; rows' bounds in them."""
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in lowered])))
    out, h = [], np.zeros(len(points), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint32(0x01000193) + (points[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int64))
    return out, bounds


def _rows(grams: list[np.ndarray], bounds: np.ndarray, r: int) -> np.ndarray:
    """All buckets of row r; an n-gram lies inside the row."""
    return np.concatenate([g[bounds[r] : max(bounds[r], bounds[r + 1] - n + 1)] for n, g in zip(ORDERS, grams, strict=False)])


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, lowest first, as many as the largest one has."""
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size].T.tobytes()


def _numbers(planes: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(planes, np.uint8).reshape(-1, max(1, n))[:, :n]
    return sum(b[i].astype(np.int64) << (8 * i) for i in range(len(b)))


def _features(batches):
    """The text's distinct buckets, as steps from each to the next, and how often it has each."""
    for batch in batches:
        for part in chunks(batch, limit=_CHUNK):
            grams, bounds = _grams(part.column("text").to_pylist())
            steps, counts, sizes = [], [], []
            for r in range(part.num_rows):
                count = np.bincount(_rows(grams, bounds, r), minlength=1 << BITS)
                at = np.flatnonzero(count)
                sizes.append(len(at))
                steps.append(_planes(np.diff(at, prepend=0)))
                counts.append(_planes(count[at]))
            keep = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(sizes, pa.int32()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())], [*keep, "size", "steps", "counts"])


def _unpacked(batches):
    """(buckets, counts, row) of each row of ``_features``."""
    for batch in batches:
        for r in batch.to_pylist():
            yield np.cumsum(_numbers(r["steps"], r["size"])), _numbers(r["counts"], r["size"]), r


def _frequencies(batches):
    df, docs = np.zeros(1 << BITS, dtype=np.int64), 0
    for at, _, _ in _unpacked(batches):
        df[at] += 1
        docs += 1
    if docs:
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], docs), pa.int64())], ["bucket", "n"])


class _State:
    """Coordinates of the regularised leader: z and n by bucket and class."""

    def __init__(self, z, n, alpha=0.5, beta=1.0, l1=0.02, l2=0.02) -> None:
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def _train(idf, langs, state, epoch: int):
    """The state after each share; a share's rows follow each other in one task."""

    def learned(s: _State, block: list) -> None:
        for r in np.random.default_rng(epoch).permutation(len(block)):
            at, count, y = block[r]
            s.learn(at, count * idf.value[at] * (SCALE / count.sum()), y)

    def result(s: _State, share: int, seen: int):
        for k in range(0, 1 << BITS, SLICE):
            z, n = (pa.array([x[k : k + SLICE].tobytes()], pa.binary()) for x in (s.z, s.n))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([share], pa.int32()), pa.array([seen], pa.int64()), z, n], ["first", "share", "seen", "z", "n"])

    def run(batches):
        index, s, share, seen, block = {x: i for i, x in enumerate(langs)}, None, None, 0, []
        for at, count, r in _unpacked(batches):
            if s is None or r["share"] != share:
                if s is not None:
                    learned(s, block)
                    yield from result(s, share, seen)
                z, n = state.value
                s, share, seen, block = _State(z.copy(), n.copy()), r["share"], 0, []
            block.append((at, count, index[r["lang"]]))
            seen += 1
            if len(block) == BLOCK:
                learned(s, block)
                block = []
        if s is not None:
            learned(s, block)
            yield from result(s, share, seen)

    return run


def _average(batches):
    """The mean of the tasks' states, weighted by the rows that each has seen, slice by slice, from rows in their order."""
    total: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            z, n = (np.frombuffer(r[c]) * r["seen"] for c in ("z", "n"))
            old = total.get(r["first"])
            total[r["first"]] = [old[0] + r["seen"], old[1] + z, old[2] + n] if old else [r["seen"], z, n]
    for k, (seen, z, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([seen], pa.int64()), *(pa.array([(x / seen).tobytes()], pa.binary()) for x in (z, n))], ["first", "seen", "z", "n"])


def _logits(model):
    """model: broadcast of (idf-scaled weights, languages, temperature)."""

    def of(texts: list[str]) -> np.ndarray:
        weights, langs, _ = model.value
        grams, bounds = _grams(texts)
        out, total = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
        for n, g in zip(ORDERS, grams, strict=False):
            size = np.maximum(np.diff(bounds) - n + 1, 0)
            total += size
            stop = np.minimum(bounds[:-1] + size, len(g))
            for c in range(len(langs)):
                sums = np.concatenate(([0.0], np.cumsum(weights[c][g], dtype=np.float64)))
                out[:, c] += sums[stop] - sums[np.minimum(bounds[:-1], stop)]
        return out * (SCALE / np.maximum(total, 1))[:, None]

    return of


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _predict(model):
    def run(batches):
        _, langs, temperature = model.value
        for batch in batches:
            for part in chunks(batch, limit=_CHUNK):
                texts = part.column("text").to_pylist()
                s = _logits(model)([t or "" for t in texts]) / temperature
                p = _softmax(s)
                best = p.argmax(axis=1)
                ok = [has_letter(t) for t in texts]
                lang = [langs[b] if k else "und" for b, k in zip(best, ok, strict=True)]
                score = np.where(ok, p[np.arange(len(best)), best], 0.0)
                keep = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return run


_GRID = np.geomspace(0.05, 20, 121)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _labelled(model, rows):
    """Logits of rows of ``_features``, with the place of their language."""
    weights, langs, _ = model.value
    index = {x: i for i, x in enumerate(langs)}
    for at, count, r in _unpacked(rows):
        yield (weights[:, at].astype(np.float64) @ count) * (SCALE / count.sum()), index[r["lang"]]


_UNITS = float(1 << 24)


def _losses(model):
    """A task's log loss at each temperature of the grid; rows' losses are whole numbers of 2**-24, so that sums don't hang on their order."""

    def run(batches):
        total, n = np.zeros(len(_GRID), dtype=np.int64), 0
        for s, y in _labelled(model, batches):
            d = (s - s.max())[None, :] / _GRID[:, None]
            total += np.rint((np.log(np.exp(d).sum(axis=1)) - d[:, y]) * _UNITS).astype(np.int64)
            n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(_GRID)), pa.int32()), pa.array(total)], ["step", "loss"])

    return run


def _temperature(rows) -> float:
    """rows: the loss of each step of the grid."""
    return float(_GRID[min(rows, key=lambda r: (r.loss, r.step)).step]) if rows else 1.0


def _surest(model):
    """How many rows have their highest probability in each step of ``STEPS``."""

    def run(batches):
        count = np.zeros(STEPS + 1, dtype=np.int64)
        for s, _ in _labelled(model, batches):
            count[int(_softmax(s[None, :] / model.value[2]).max() * STEPS)] += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at])], ["step", "n"])

    return run


def _reached(rows) -> float | None:
    """What all but a thousandth reach; rows: counts by step."""
    left = sum(r.n for r in rows) // 1000
    for r in sorted(rows, key=lambda r: r.step):
        if r.n > left:
            return r.step / STEPS
        left -= r.n
    return None


def _floor(reached: float | None, langs: int) -> float:
    """Half way from chance to the score that nearly all rows reach."""
    return 0.0 if reached is None else (1 / langs + reached) / 2


class Model:
    """``floor``: the score under which a document's language counts as unknown; ``trained``, ``calibrated``: documents that each saw."""

    def __init__(self, weights, langs: list[str], temperature: float, floor: float = 0.0, trained: int = 0, calibrated: int = 0) -> None:
        self.weights, self.langs, self.temperature, self.floor, self.trained, self.calibrated = weights, langs, temperature, floor, trained, calibrated


def _packed(spark: SparkSession, labelled: DataFrame, shares: int) -> DataFrame:
    """The features of labelled rows in a folder for each share, one file each, in the order of training."""
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5 * shares))
    rows = labelled.select("doc_id", "lang", "text", F.floor(part / 5).cast("int").alias("share"), (part % 5 == 0).alias("unseen"))
    kinds = "doc_id string, lang string, share int, unseen boolean, size int, steps binary, counts binary"
    dealt = rows.mapInArrow(_features, kinds).repartition(shares, "share").sortWithinPartitions("share", F.xxhash64("doc_id", F.lit("order")), "doc_id", "steps", "counts", "lang")
    path = scratch(spark)
    dealt.drop("doc_id").write.option("compression", "zstd").partitionBy("share").parquet(path)
    return spark.read.schema("lang string, unseen boolean, size int, steps binary, counts binary, share int").parquet(path)


def fit(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int | None = None, folds: int = 4, fold: int = 2) -> Model:
    own, text, lang = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")
    labelled = docs.where(own.isNotNull() & text.isNotNull() & lang.isNotNull() & ~held_out(own, folds, fold)).select(own.cast("string").alias("doc_id"), text.alias("text"), lang.alias("lang"))
    common = labelled.groupBy("lang").count().collect()  # one row a language
    langs = sorted(r.lang for r in common)
    if not langs:
        return Model(np.zeros((0, 1 << BITS), np.float32), [], 1.0)
    if max_train is not None:
        least = max(LEAST_ROWS, max_train // len(langs))
        drawn = spark.createDataFrame([(r.lang, int(min(1.0, least / r["count"]) * (1 << 30))) for r in common], "lang string, most long")
        labelled = labelled.join(F.broadcast(drawn), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.col("most"))  # one row a language
    packed = _packed(spark, labelled, max(WORKERS, -(-sum(r["count"] for r in common) // SHARE_ROWS)))
    counts = packed.mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # 2**BITS rows at most
    df, n_docs = np.zeros(1 << BITS), next((r.n for r in counts if r.bucket == -1), 0)
    for r in counts:
        df[r.bucket] = r.n if r.bucket >= 0 else df[r.bucket]
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    z, n, trained = np.zeros((1 << BITS, len(langs))), np.zeros((1 << BITS, len(langs))), 0
    sent = spark.sparkContext.broadcast(idf)
    for epoch in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n))
        states = packed.where(~F.col("unseen")).mapInArrow(_train(sent, langs, state, epoch), "first int, share int, seen long, z binary, n binary")
        mean = states.repartition("first").sortWithinPartitions("first", "share").mapInArrow(_average, "first int, seen long, z binary, n binary").collect()  # one state
        state.destroy()
        for r in mean:
            trained = r.seen
            for x, got in ((z, r.z), (n, r.n)):
                x[r.first : r.first + SLICE] = np.frombuffer(got).reshape(-1, len(langs))
    weights = (_State(z, n).weights() * idf[:, None]).T.astype(np.float32).copy()
    raw = spark.sparkContext.broadcast((weights, langs, 1.0))
    unseen = packed.where("unseen")
    temperature = _temperature(unseen.mapInArrow(_losses(raw), "step int, loss long").groupBy("step").agg(F.sum("loss").alias("loss")).collect())  # a row for each step of the grid
    cooled = spark.sparkContext.broadcast((weights, langs, temperature))
    surest = unseen.mapInArrow(_surest(cooled), "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()  # STEPS + 1 rows at most
    for x in (sent, raw, cooled):
        x.destroy()
    drop_stored(spark, packed)
    return Model(weights, langs, temperature, _floor(_reached(surest), len(langs)), trained, sum(r.n for r in surest))


def predict(spark: SparkSession, docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, then lang_pred and score."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("text"))
    if not model.langs:
        return rows.drop("text").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast((model.weights, model.langs, model.temperature))), f"{kinds}, lang_pred string, score double")


def accepted(spark: SparkSession, docs: DataFrame, model: Model, *, text_col: str = "text", least: float | None = None) -> DataFrame:
    """docs without those whose language can't be told (``und``) or has a score under ``least`` (the model's floor by default)."""
    columns, least = docs.columns, model.floor if least is None else least
    if not model.langs:
        return docs.limit(0)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = predict(spark, packed, model, keep=("row",))
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*[F.col("row").getField(c).alias(c) for c in columns])

"""Language of texts by a convolutional network over bytes, trained in numpy.

A text is cut into windows of WINDOW bytes that overlap by the widest filter less one, the
last filled up with zeros.  A window's bytes become vectors of EMBED numbers, filters of
several widths slide over them by STRIDE bytes, each filter's largest response in the window
stays (max pooling) and is rectified, and a softmax over languages follows.  A text's scores
are the mean of its windows' log-probabilities, each weighing as many bytes as it has, and
normalised again; every byte of the text counts.

All of embedding, filters and softmax are learnt by Adam steps on batches of windows, half
of them cut short, the gradient going through the place of each filter's largest response.
The fit takes at most
MOST_DOCS documents of each language, those first in an order by hash, and of each at most
DOC_WINDOWS windows, evenly spread; languages weigh alike.  The driver fits bytes of those
windows (under 0.7 MB a language); everything else runs in batches on executors.

Defined results: a null text, one without a letter (of any script), and any text where no
language could be learnt give ``und`` with score 0; with one language its score is 1;
repeated rows are judged each; documents with a null id or language aren't learnt from, and of
those with one id and language the first text in order;
equal scores go to the language first in order; columns besides doc_id, text and lang are
not read; an empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.buffers import blocks, text_buffer
from tidemark.llm.shared import crc32_mod, map_arrow, table

WINDOW, STRIDE, EMBED, WIDTHS, FILTERS = 256, 2, 8, (2, 3, 4, 5), 16
MOST_DOCS, DOC_WINDOWS = 600, 4
STEPS, BATCH, RATE, SHORTEST, SEED = 500, 64, 0.01, 24, 13
HELD_MOD, HELD_REST = 5, 0
UNKNOWN = "und"
#: Windows that are run at once; shares of a language in which documents are ranked first.
AT_ONCE, SHARES = 64, 64

_WIDEST = max(WIDTHS)
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, a row each, each one's text and bytes; an empty text has none."""
    step = WINDOW - _WIDEST + 1
    length = np.diff(offsets)
    count = np.where(length > 0, np.maximum(1, -(-(length - _WIDEST + 1) // step)), 0)
    text = np.repeat(np.arange(len(length)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + at * step
    size = np.minimum(WINDOW, offsets[text + 1] - start)
    out = sliding_window_view(np.append(raw, np.zeros(WINDOW, np.uint8)), WINDOW)[start] if len(start) else np.zeros((0, WINDOW), np.uint8)
    return np.where(np.arange(WINDOW) < size[:, None], out, np.uint8(0)), text, size


@dataclass
class Model:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # _WIDEST * EMBED x filters of all widths; a narrow filter's last rows are zero
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, some: np.ndarray) -> np.ndarray:
        """Windows x places x filters."""
        n = len(some)
        patches = sliding_window_view(self.embed[some].reshape(n, -1), _WIDEST * EMBED, 1)[:, :: STRIDE * EMBED]
        return (patches.reshape(-1, _WIDEST * EMBED) @ self.filters).reshape(n, -1, self.filters.shape[1])

    def log_probabilities(self, some: np.ndarray) -> np.ndarray:
        z = np.zeros((len(some), len(self.langs)), np.float32)
        for i in range(0, len(some), AT_ONCE):
            z[i : i + AT_ONCE] = np.maximum(self.responses(some[i : i + AT_ONCE]).max(1) + self.bias, 0) @ self.out + self.out_bias
        return z - np.logaddexp.reduce(z, axis=1, keepdims=True)


def fit(some: np.ndarray, size: np.ndarray, label: np.ndarray, langs: list[str], steps: int = STEPS) -> Model:
    """A model from windows, their bytes and the places of their languages in langs."""
    rng = np.random.default_rng(SEED)
    k = FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat(np.arange(_WIDEST) < w, EMBED).repeat(FILTERS).reshape(-1, FILTERS) for w in WIDTHS], 1)
    normal = lambda *shape: rng.normal(size=shape).astype(np.float32)
    theta = [normal(256, EMBED) * 0.5, normal(_WIDEST * EMBED, k) * mask * 0.2, np.zeros(k, np.float32), normal(k, len(langs)) * 0.1, np.zeros(len(langs), np.float32)]
    mean, square = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    by_label = [np.flatnonzero(label == i) for i in range(len(langs))]
    for step in range(1, steps + 1):
        y = rng.integers(len(langs), size=BATCH)
        pick = np.array([by_label[i][rng.integers(len(by_label[i]))] for i in y])
        keep = np.where(rng.random(BATCH) < 0.5, size[pick], rng.integers(SHORTEST, WINDOW + 1, BATCH))
        batch = np.where(np.arange(WINDOW) < keep[:, None], some[pick], np.uint8(0))
        model = Model(langs, *theta)
        response = model.responses(batch)
        place = response.argmax(1)
        h = np.take_along_axis(response, place[:, None], 1)[:, 0] + model.bias
        active = np.maximum(h, 0)
        z = active @ model.out + model.out_bias
        d = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        d[np.arange(BATCH), y] -= 1
        d /= BATCH
        d_h = (d @ model.out.T) * (h > 0)
        seen = batch[np.arange(BATCH)[:, None, None], place[:, :, None] * STRIDE + np.arange(_WIDEST)]
        d_filters = np.einsum("wf,wfke->kef", d_h, model.embed[seen]).reshape(-1, k) * mask
        back = d_h[:, :, None, None] * model.filters.reshape(_WIDEST, EMBED, k).transpose(2, 0, 1)
        d_embed = np.stack([np.bincount(seen.ravel(), back[..., e].ravel(), 256) for e in range(EMBED)], 1)
        for i, g in enumerate((d_embed, d_filters, d_h.sum(0), active.T @ d, d.sum(0))):
            mean[i] = 0.9 * mean[i] + 0.1 * g.astype(np.float32)
            square[i] = 0.99 * square[i] + 0.01 * g.astype(np.float32) ** 2
            theta[i] = theta[i] - RATE * (1 - step / (steps + 1)) * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-7)
    return Model(langs, *(t.astype(np.float32) for t in theta))


def _samples(batch: pa.RecordBatch):
    """At most DOC_WINDOWS windows of each text, evenly spread."""
    raw, offsets = text_buffer(batch.column(1))
    for a, b, part, at in blocks(raw, offsets):
        some, text, size = windows(part, at)
        count = np.bincount(text, minlength=b - a)
        place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        turn = lambda i: i * DOC_WINDOWS // np.maximum(count[text], DOC_WINDOWS)
        keep = np.flatnonzero((place == 0) | (turn(place) != turn(place - 1)))
        yield {"lang": batch.column(0).slice(a, b - a).take(pa.array(text[keep])), "bytes": [w.tobytes() for w in some[keep]], "size": size[keep]}


def train(docs: DataFrame) -> Model:
    """A model from rows of (doc_id, text, lang), fitted by the driver on a bounded sample's windows."""
    good = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    # Ids are ranked by themselves, first within shares of a language: texts move only for those that are chosen.
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("key", "doc_id")) <= MOST_DOCS
    key = F.xxhash64("doc_id")
    some = good.select("lang", "doc_id", key.alias("key"), F.pmod(key, F.lit(SHARES)).alias("share")).withColumn("in", first("lang", "share")).where("in")
    some = some.repartition("lang").withColumn("in", first("lang")).where("in").select("lang", "doc_id").distinct()
    chosen = good.join(some, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")
    found = map_arrow(chosen, _samples, "lang string, bytes binary, size long").toArrow().sort_by([("lang", "ascending"), ("bytes", "ascending")])
    langs = sorted(set(found["lang"].to_pylist()))
    some = np.frombuffer(b"".join(found["bytes"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    label = np.array([langs.index(x) for x in found["lang"].to_pylist()], np.int64)
    return fit(some, found["size"].to_numpy(), label, langs, STEPS if len(langs) > 1 else 0)


def _lettered(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    plain = np.concatenate([[0], np.cumsum(_letter[raw])])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(map(str.isalpha, raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def judged(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each text's language, -1 if unknown, and its score."""
    n, k = len(offsets) - 1, len(model.langs)
    if not k:
        return np.full(n, -1), np.zeros(n)
    some, text, size = windows(raw, offsets)
    logs = model.log_probabilities(some)
    total = np.stack([np.bincount(text, logs[:, i] * size, n) for i in range(k)], 1) / np.maximum(1, np.bincount(text, size, n))[:, None]
    p = np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))
    best, good = p.argmax(1), _lettered(raw, offsets)
    return np.where(good, best, -1), np.where(good, np.clip(p[np.arange(n), best], 0, 1), 0.0)


def identified(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of (doc_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        names = pa.array([*shared.value.langs, UNKNOWN], pa.string())
        raw, offsets = text_buffer(batch.column(1))
        for a, b, part, at in blocks(raw, offsets):
            best, score = judged(shared.value, part, at)
            yield {"doc_id": batch.column(0).slice(a, b - a), "lang_pred": names.take(pa.array(np.where(best < 0, len(names) - 1, best))), "score": score}

    return map_arrow(df.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def op13_byte_network(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    held = crc32_mod("doc_id", HELD_MOD) == HELD_REST
    model = train(docs.where(~held))
    return identified(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")

"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in windows of ``width`` bytes, one after the other over the whole text. In each
window one GRU runs forwards and one backwards; at every position the two states give a probability of
each language, and a document's probabilities are the normalised geometric mean over all its positions.
The network is trained here, in numpy, by backpropagation through time and Adam, on the loss of every position.

Training takes a bounded sample of labelled rows: of the ``max_languages`` commonest labels at most ``per_language``
documents each, fewer where all would be over ``max_sample``; those first in a hash order of ids, and two windows of
each at places given by the hash. Rows with crc32(doc_id) mod 4 = 2 are never seen. Prediction reads nothing but the
text, the whole of it.

Edge cases: a null text, or one without a letter, is "und" with score 0; with no labelled row at all
every text is "und"; a null id is not learned from and not held out; repeated rows are judged alike; long texts are
windows like any others; an empty table gives an empty result; extra columns are ignored by identify and ride along,
whatever their names, in keep_known_languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, text_or_empty, tidied

UND = "und"
PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fresh(hidden: int, classes: int, rng) -> dict[str, np.ndarray]:
    """E: what a byte adds to the gates z, r and n; U: what the state adds; V: state to languages; b: bias of languages."""
    p = {"b": np.zeros(classes)}
    for d in "fb":
        p |= {"E" + d: rng.normal(0, 0.3, (3 * hidden, 256)), "U" + d: rng.normal(0, hidden**-0.5, (3 * hidden, hidden)), "V" + d: rng.normal(0, hidden**-0.5, (classes, hidden))}
    return {k: v.astype(np.float32) for k, v in p.items()}


def run_gru(E, U, x):
    """States after each of the T columns of x (T, B), and the gates, kept for the backward pass."""
    h = U.shape[1]
    state, kept = np.zeros((h, x.shape[1]), np.float32), []
    for xt in x:
        a, g = E[:, xt], U @ state
        zr = sigmoid(a[: 2 * h] + g[: 2 * h])
        z, r = zr[:h], zr[h:]
        n = np.tanh(a[2 * h :] + r * g[2 * h :])
        kept.append((state, z, r, n, g[2 * h :]))
        state = n + z * (state - n)
    return np.stack([k[0] for k in kept[1:]] + [state]), kept


def back_through_time(E, U, x, kept, d_states):
    """Gradients of E and U from those of the states."""
    dE, dU = np.zeros_like(E), np.zeros_like(U)
    h, dh = U.shape[1], 0.0
    columns = np.arange(256)
    for t in range(len(x) - 1, -1, -1):
        before, z, r, n, gn = kept[t]
        dh = dh + d_states[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        da = np.concatenate([dz, dr, dn])
        dg = np.concatenate([dz, dr, dn * r])
        dE += da @ (x[t][:, None] == columns).astype(np.float32)
        dU += dg @ before.T
        dh = dh * z + U.T @ dg
    return dE, dU


def train(windows: np.ndarray, labels: np.ndarray, classes: int, hidden: int = 8, steps: int = 260, batch: int = 192, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """windows (N, T) uint8, 0 where the text has ended; labels (N,)."""
    rng = np.random.default_rng(seed)
    p = fresh(hidden, classes, rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        x, y = np.ascontiguousarray(windows[pick].T), labels[pick]
        mask = (x > 0).astype(np.float32)
        (sf, kf), (sb, kb) = run_gru(p["Ef"], p["Uf"], x), run_gru(p["Eb"], p["Ub"], x[::-1])
        logits = np.einsum("ch,thb->tcb", p["Vf"], sf) + np.einsum("ch,thb->tcb", p["Vb"], sb[::-1]) + p["b"][:, None]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        prob[:, y, np.arange(batch)] -= 1
        d = prob * (mask / max(1.0, mask.sum()))[:, None, :]
        g = {"b": d.sum((0, 2)), "Vf": np.einsum("tcb,thb->ch", d, sf), "Vb": np.einsum("tcb,thb->ch", d, sb[::-1])}
        g["Ef"], g["Uf"] = back_through_time(p["Ef"], p["Uf"], x, kf, np.einsum("ch,tcb->thb", p["Vf"], d))
        g["Eb"], g["Ub"] = back_through_time(p["Eb"], p["Ub"], x[::-1], kb, np.einsum("ch,tcb->thb", p["Vb"], d)[::-1])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        lr = rate * min(1.0, 4 * (1 - step / (steps + 1)))
        for k in p:
            grad = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def label_positions(p: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """(N, classes): each window's sum over its positions of the log-probabilities."""
    x = np.ascontiguousarray(windows.T)
    hidden, classes = p["Uf"].shape[1], len(p["b"])
    logits = np.empty((len(x), classes, x.shape[1]), np.float32)
    half = np.repeat(np.float32([0.5, 0.5, 1]), hidden)[:, None]  # sigmoid(x) = (tanh(x / 2) + 1) / 2
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        E, U, V = p["E" + d] * half, p["U" + d] * half, p["V" + d]
        state = np.zeros((hidden, x.shape[1]), np.float32)
        a, g, out = np.empty((3 * hidden, x.shape[1]), np.float32), np.empty((3 * hidden, x.shape[1]), np.float32), np.empty((classes, x.shape[1]), np.float32)
        for t in order:
            np.take(E, x[t], axis=1, out=a, mode="clip")
            np.matmul(U, state, out=g)
            zr, n = a[: 2 * hidden], a[2 * hidden :]
            zr += g[: 2 * hidden]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            gn = g[2 * hidden :]
            gn *= zr[hidden:]
            n += gn
            np.tanh(n, out=n)
            state -= n
            state *= zr[:hidden]
            state += n
            if d == "f":
                np.matmul(V, state, out=logits[t])
            else:
                logits[t] += np.matmul(V, state, out=out)
    logits += p["b"][:, None]
    logits -= logits.max(1, keepdims=True)
    whole = np.log(np.exp(logits).sum(1))
    mask = (x > 0).astype(np.float32)
    return np.einsum("tcb,tb->bc", logits, mask) - (whole * mask).sum(0)[:, None]


def cut_windows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, and how many each text has."""
    counts = np.array([-(-len(t) // width) for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(n * width, b"\0") for t, n in zip(texts, counts.tolist())), np.uint8).reshape(-1, width), counts


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, per_language: int, width: int, max_languages: int = 1_024, max_sample: int = 40_000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, windows and labels, from a bounded sample: max_sample documents at most, or one of each language."""
    seen = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    common = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    counts = {r.lang: r.n for r in common.collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, width), np.uint8), np.zeros(0, np.int64)
    each = max(1, min(per_language, max_sample // len(languages)))
    order = F.xxhash64(F.lit(11), "doc_id")
    # thinned first, so that few rows are ranked; the rank makes the bound exact
    rate = F.broadcast(docs.sparkSession.createDataFrame([(k, min(1.0, (1.5 * each + 50) / n)) for k, n in counts.items()], "lang string, rate double"))
    some = seen.join(rate, "lang").where(F.pmod(order, F.lit(1_000_000)) <= F.col("rate") * 1_000_000)
    at = [(F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.greatest(F.length("text") - width + 1, F.lit(1))) + 1).cast("int") for i in (1, 2)]
    pieces = some.select("lang", order.alias("o"), *[F.substring("text", a, F.lit(width)).alias(f"w{i}") for i, a in enumerate(at)])
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("o", "w0", "w1")))
    rows = ranked.where(F.col("rank") <= each).orderBy("o", "lang", "w0", "w1").collect()
    number = {k: i for i, k in enumerate(languages)}
    windows = [piece.encode()[:width].ljust(width, b"\0") for r in rows for piece in (r.w0, r.w1)]
    return languages, np.frombuffer(b"".join(windows), np.uint8).reshape(-1, width), np.repeat([number[r.lang] for r in rows], 2)


def judge(texts: list[str], has_letter: list, model: dict, languages: list[str], width: int) -> tuple[list[str], np.ndarray]:
    """The language and score of each text of a batch."""
    known = np.array([bool(languages) and bool(x) for x in has_letter])
    data = [t.encode() if k else b"" for t, k in zip(texts, known)]
    total = np.zeros((len(data), max(1, len(languages))))
    if known.any():
        x, counts = cut_windows(data, width)
        owner = np.repeat(np.arange(len(data)), counts)
        step = max(64, 4096 * 4 // max(4, len(languages)))  # bounds what all positions and languages take
        for at in range(0, len(x), step):
            np.add.at(total, owner[at : at + step], label_positions(model, x[at : at + step]))
    mean = total / np.maximum([len(t) for t in data], 1)[:, None]
    prob = np.exp(mean - mean.max(1, keepdims=True))
    prob /= prob.sum(1, keepdims=True)
    return [languages[b] if k else UND for b, k in zip(prob.argmax(1), known)], np.where(known, prob.max(1), 0.0)


def fitted(docs: DataFrame, per_language: int, width: int, id_col: str, text_col: str, lang_col: str) -> tuple[dict, list[str]]:
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    languages, windows, labels = training_windows(base, per_language, width)
    return (train(windows, labels, len(languages)) if languages else {}), languages


def identify(docs: DataFrame, per_language: int = 1_200, width: int = 96, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out boolean, lang_pred string, score double, for every row of docs."""
    model, languages = fitted(docs, per_language, width, id_col, text_col, lang_col)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def predict(batches):
        for batch in slices(batches):
            found, score = judge(batch.column(1).to_pylist(), batch.column(2).to_pylist(), model, languages, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score)], schema=PREDICTED)

    told = base.select("doc_id", text_or_empty("text").alias("text"), F.col("text").rlike(r"\p{L}").alias("has_letter")).mapInArrow(tidied(predict), "doc_id long, lang_pred string, score double")
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known_languages(docs: DataFrame, min_score: float = 0.4, per_language: int = 1_200, width: int = 96, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language can be told: those that are "und", or score below min_score, go. With no labelled row nothing can be told, and all with a letter stay."""
    model, languages = fitted(docs, per_language, width, id_col, text_col, lang_col)
    text = F.col(f"`{text_col}`").cast("string")
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    if not languages:
        return docs.where(letter)

    place, n = docs.columns.index(text_col), len(docs.columns)

    def keep(batches):
        for batch in slices(batches):
            letters = batch.column(n).to_pylist()
            texts = [str(t) if k else "" for t, k in zip(batch.column(place).to_pylist(), letters)]
            _, score = judge(texts, letters, model, languages, width)
            yield batch.filter(pa.array(score >= min_score)).select(list(range(n)))

    # columns travel by number, whatever their names, and the text once
    asked = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], letter.alias("letter"))
    kept = asked.mapInArrow(tidied(keep), asked.drop("letter").schema)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))

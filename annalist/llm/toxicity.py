"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read the words of a clause as symbols: insult (weighted), threat, target, negation and reported
speech. Their composition is one machine whose state says what has been seen; each insult or threat leaves it with a
weight, plain, negated or reported. What the clause's last state says of a target decides, as the machine's final
output, whether its plain insults were aimed at somebody and its threats count. A clause without insult or threat is not
run. A document's channels (plain, targeted, negated, reported, threat) and matched clauses, with its length, enter a
logistic model; words that match outside any clause rule are no inputs. An apostrophe separates words,
so a contraction of a class is met at its second word (isn t), read with the word before it.

What is learned from labels: the insult arcs (words and word beginnings whose rate in toxic documents stands out) and
the logistic weights, each on its own half of a bounded sample of labelled rows (SAMPLE rows of each class, by hash).
Sampled rows are weighted so that the classes count at the rates of all usable labels, whatever the sample holds.
Labels, language, source and id are never inputs of a score.

Rows: a null or empty text has no words and the score of a text without matches. Labels that are null, repeated or
of unknown documents are ignored or counted once each. Equal texts have equal scores. Without labelled documents of both
classes (ten at least) every score is the rate of class 1 among all usable labels; without any labels it is 1/3, so that
nothing is rejected. An empty table gives no rows; other columns are ignored.
Very long texts are scored whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NOT_ALNUM, Words, arrow_map, byte_sums, mix, pack, pieces, text_buffers, unpack

# Closed word classes of the grammar, in four languages.
THREAT = "kill hurt destroy crush smash burn beat murder shoot stab töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGET = "you your you're yourself he she they them him her people those du dich ihr euch sie tu toi vous ils elle eux tú ti usted ellos ella".split()
NEGATION = "not no never nobody isn't wasn't don't nicht kein keine nie ne pas jamais aucun nunca ningún jamás".split()
REPORTED = "said says say claimed wrote called quoted quote reported according sagte schrieb behauptete dit écrit affirme dijo escribió afirmó".split()
#: Words after a negation that it reaches.
REACH = 3
#: Labelled rows of each class that the model is fitted on, and the least evidence for an insult arc.
SAMPLE, LEAST_DOCS, LEAST_ODDS, LEAST_Z = 4000, 6, 2.0, 5.0
#: Word beginnings that can be arcs, in bytes; 0 is the whole word.
LENGTHS = (0, 4, 5, 6, 7, 8, 10)
CHANNELS = ("plain", "targeted", "negated", "reported", "threat")


# --- transducers -----------------------------------------------------------------------------------------------

OTHER, INSULT, THREATS, TARGETS, NEGATIONS, REPORTS = range(6)


class Transducer:
    """States from 0, step(state, symbol) -> (state, label), and final(state): what it says at a clause's end."""

    def __init__(self, states: int, step, final=lambda s: None):
        self.states, self.step, self.final = states, step, final


def compose(parts: list[Transducer]) -> tuple[list[list[tuple[int, tuple]]], list[tuple]]:
    """The product of transducers reading the same symbols: table[state][symbol] = (state, labels), and final labels by state."""
    sizes = [p.states for p in parts]
    table, finals = [], []
    for s in range(int(np.prod(sizes))):
        own, rest = [], s
        for n in sizes:
            own.append(rest % n)
            rest //= n
        row = []
        for symbol in range(6):
            out = [p.step(x, symbol) for p, x in zip(parts, own)]
            to, unit = 0, 1
            for (x, _), n in zip(out, sizes):
                to, unit = to + x * unit, unit * n
            row.append((to, tuple(label for _, label in out)))
        table.append(row)
        finals.append(tuple(p.final(x) for p, x in zip(parts, own)))
    return table, finals


GRAMMAR, FINALS = compose([
    Transducer(1, lambda s, x: (0, x == INSULT)),
    Transducer(1, lambda s, x: (0, x == THREATS)),
    Transducer(REACH + 1, lambda s, x: (REACH if x == NEGATIONS else max(0, s - 1), s > 0)),
    Transducer(2, lambda s, x: (1 if x == REPORTS else s, bool(s))),
    Transducer(2, lambda s, x: (1 if x == TARGETS else s, None), bool),
])


def run_clause(symbols: list[int], weights: list[float]) -> list[float]:
    """The channels of one clause: what its insults and threats leave, by the final output of the last state."""
    plain = negations = reports = threats = 0.0
    state = 0
    for x, w in zip(symbols, weights):
        state, (insult, threat, negated, reported, _) = GRAMMAR[state][x]
        if insult:
            if negated:
                negations += w
            elif reported:
                reports += w
            else:
                plain += w
        elif threat and not negated and not reported:
            threats += 1.0
    aimed = FINALS[state][-1]
    return [0.0 if aimed else plain, plain if aimed else 0.0, negations, reports, threats if aimed else 0.0]


# --- words and arcs --------------------------------------------------------------------------------------------


def _prefix_hashes(words: Words, which: np.ndarray) -> list[np.ndarray]:
    """For each of LENGTHS a hash of the beginnings of the given words; 0 where a word is not longer than that."""
    sums, up = byte_sums(words.data, True)
    a, e = words.start[which], words.end[which]
    out = []
    for n in LENGTHS:
        end = np.minimum(a + n, e) if n else e
        h = mix((sums[end] - sums[a]) * up[a] + np.uint64(n + 1))
        out.append(np.where(e - a > n, h, np.uint64(0)) if n else h)
    return out


def _types(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a piece: (hashes of all words, first places, index of each word's type)."""
    h = words.hashes(lower=True)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    return h, first, back


def word_weights(words: Words, arcs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weight of each word of a piece as an insult: its best arc."""
    if not len(words.start) or not len(arcs):
        return np.zeros(len(words.start))
    _, first, back = _types(words)
    best = np.zeros(len(first))
    for h in _prefix_hashes(words, first):
        at = np.minimum(np.searchsorted(arcs, h), len(arcs) - 1)
        best = np.maximum(best, np.where(arcs[at] == h, weights[at], 0.0))
    return best[back]


_CLASSES = {w.encode(): k for k, ws in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORTED)) for w in ws}
_ENDS = frozenset(b".!?;\n")


def _class_hashes():
    data, off = text_buffers(pa.array(THREAT))
    return np.sort(Words(data, off, NOT_ALNUM).hashes(lower=True))


def piece_features(data: np.ndarray, offsets: np.ndarray, arcs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each document of a piece: the channels, matched clauses, and words."""
    words = Words(data, offsets, NOT_ALNUM)
    weight = word_weights(words, arcs, weights)
    threats = np.isin(words.hashes(lower=True), _class_hashes())
    out = np.zeros((len(offsets) - 1, len(CHANNELS) + 2))
    out[:, -1] = words.counts()
    hits = np.flatnonzero((weight > 0) | threats)
    raw, done = data.tobytes(), -1
    low = raw.lower() if len(hits) else b""
    start, end, of = words.start, words.end, words.of
    docs = np.searchsorted(of, hits, side="right") - 1
    for i, d in zip(hits.tolist(), docs.tolist()):
        if i <= done:
            continue  # in the clause that was just read
        a, first, last = i, int(of[d]), int(of[d + 1])
        while a > first and not _ENDS.intersection(raw[end[a - 1] : start[a]]):
            a -= 1
        b = i + 1
        while b < last and not _ENDS.intersection(raw[end[b - 1] : start[b]]):
            b += 1
        done = b - 1
        symbols = [INSULT if weight[k] > 0 else _CLASSES.get(low[start[k] : end[k]]) or k > a and _CLASSES.get(low[start[k - 1] : end[k]]) or OTHER for k in range(a, b)]
        channels = run_clause(symbols, weight[a:b].tolist())
        out[d, : len(CHANNELS)] += channels
        out[d, len(CHANNELS)] += any(channels)
    return out


def _inputs(f: np.ndarray) -> np.ndarray:
    """Inputs of the logistic model from features: 1, channels as they are and by length, matched clauses, length."""
    n = np.maximum(f[:, -1:], 1.0)
    c = f[:, : len(CHANNELS)]
    per = np.minimum(100.0 * c / n, 20.0)
    return np.hstack([np.ones((len(f), 1)), np.log1p(c), per, np.log1p(f[:, -2:-1]), np.log1p(n)])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 40, worth=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge-penalised logistic regression of rows of given worth (1 each) by Newton steps: (mean, scale, weights)."""
    worth = np.ones(len(y)) if worth is None else worth
    mean = np.average(x, 0, worth)
    scale = np.sqrt(np.average((x - mean) ** 2, 0, worth))
    mean[0], scale[0] = 0.0, 1.0
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (worth * (p * (1 - p) + 1e-6))[:, None]).T @ z + np.diag(penalty), z.T @ (worth * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


# --- learning --------------------------------------------------------------------------------------------------


def held_out(id_col: str, folds: int = 5):
    """Rows that are never learned from: crc32 of the id as text, modulo folds, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def usable(labels: DataFrame, label_id: str, label_col: str) -> DataFrame:
    """(id, y): the labels that may be learned from, one for each id."""
    return labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))


def sample_of(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_id: str, label_col: str) -> DataFrame:
    """(text, y, half): at most sample labelled rows of each class that are not held out, chosen by a hash of the id."""
    ids = usable(labels, label_id, label_col)
    order = F.xxhash64(F.col("id"), F.lit(5))
    picked = ids.where("y = 1").orderBy(order, "id").limit(sample).unionByName(ids.where("y = 0").orderBy(order, "id").limit(sample))
    half = F.pmod(F.xxhash64(F.col("id"), F.lit(6)), F.lit(2)).cast("int")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.join(F.broadcast(picked), "id").select("text", "y", half.alias("half"))


def class_counts(labels: DataFrame, label_id: str, label_col: str) -> np.ndarray:
    """All usable labels of class 0 and 1."""
    n = {r["y"]: r["count"] for r in usable(labels, label_id, label_col).groupBy("y").count().collect()}
    return np.array([n.get(0, 0), n.get(1, 0)], float)


def class_worth(whole: np.ndarray, sample: int) -> np.ndarray:
    """What a sampled row of class 0 and 1 counts: the class's share of all usable labels over its share of the sample."""
    taken = np.minimum(whole, sample)
    return np.divide(whole * max(taken.sum(), 1.0), taken * max(whole.sum(), 1.0), out=np.ones(2), where=taken > 0)


def _counts(batches):
    """Per piece: arcs and how many documents of each class (and half 0) hold them."""
    for p in pieces(batches, 0):
        keep = np.flatnonzero(p.column(2).to_numpy(zero_copy_only=False) == 0)
        p = p.take(pa.array(keep))
        if not len(keep):
            continue
        words, y = Words(*text_buffers(p.column(0)), NOT_ALNUM), p.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        _, first, back = _types(words)
        doc = words.doc()
        parts = []
        for h in _prefix_hashes(words, first):
            _, group = np.unique(h, return_inverse=True)
            some = h[back] != 0
            pair = np.unique(group[back][some] * np.int64(len(y)) + doc[some])  # documents count once
            uniq = np.unique(h)
            g, d = pair // len(y), pair % len(y)
            parts.append((uniq, np.bincount(g[y[d] == 1], minlength=len(uniq)), np.bincount(g[y[d] == 0], minlength=len(uniq))))
        h, a, b = (np.concatenate([q[k] for q in parts]) for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array([pack(h, compress=False)], pa.binary()), pa.array([pack(a)], pa.binary()), pa.array([pack(b)], pa.binary()), pa.array([int((y == 1).sum())], pa.int64()), pa.array([int((y == 0).sum())], pa.int64())], names=["h", "a", "b", "toxic", "clean"])


def learn_arcs(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Insult arcs and weights from counts: the log odds of a document that holds the arc, where they stand out."""
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0)
    h = np.concatenate([unpack(r.h) for r in rows])
    keys, back = np.unique(h, return_inverse=True)
    a = np.bincount(back, np.concatenate([unpack(r.a) for r in rows]).astype(float), len(keys))
    b = np.bincount(back, np.concatenate([unpack(r.b) for r in rows]).astype(float), len(keys))
    toxic, clean = sum(r.toxic for r in rows), sum(r.clean for r in rows)
    odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
    share = (a + b) / max(toxic + clean, 1)
    spread = np.sqrt(share * (1 - share) * (1 / max(toxic, 1) + 1 / max(clean, 1)))
    z = (a / max(toxic, 1) - b / max(clean, 1)) / np.maximum(spread, 1e-9)  # of two proportions
    keep = np.flatnonzero((keys != 0) & (a >= LEAST_DOCS) & (odds >= LEAST_ODDS) & (z >= LEAST_Z))
    return keys[keep], odds[keep]


class Model:
    def __init__(self, arcs, weights, mean, scale, coef):
        self.arcs, self.weights, self.mean, self.scale, self.coef = arcs, weights, mean, scale, coef

    def scores(self, data, offsets) -> np.ndarray:
        x = _inputs(piece_features(data, offsets, self.arcs, self.weights))
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.coef, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample=SAMPLE, id_col="doc_id", text_col="text", label_id="doc_id", label_col="toxic") -> Model:
    """The model, from a bounded sample: at most 2*sample rows are ever read into it."""
    rows = sample_of(docs, labels, sample, id_col, text_col, label_id, label_col).persist()
    try:
        arcs, weights = learn_arcs(arrow_map(rows, _counts, "h binary, a binary, b binary, toxic long, clean long").collect())

        def features(batches):
            for p in pieces(batches, 0):
                f = piece_features(*text_buffers(p.column(0)), arcs, weights)
                yield pa.RecordBatch.from_arrays([p.column(1), p.column(2), pa.array(f.tolist(), pa.list_(pa.float64()))], names=["y", "half", "f"])

        got = [r for r in arrow_map(rows, features, "y int, half int, f array<double>").collect() if r.half == 1]
    finally:
        rows.unpersist()
    y = np.array([r.y for r in got], float)
    whole = class_counts(labels, label_id, label_col)
    width = _inputs(np.zeros((1, len(CHANNELS) + 2))).shape[1]
    if len(y) < 10 or y.min() == y.max():
        coef = np.zeros(width)
        coef[0] = np.log((whole[1] + 0.5) / (whole[0] + 1.0))
        return Model(arcs, weights, np.zeros(width), np.ones(width), coef)
    return Model(arcs, weights, *fit_logistic(_inputs(np.array([r.f for r in got])), y, worth=class_worth(whole, sample)[y.astype(int)]))


def score(docs: DataFrame, model: Model, columns, text_col="text") -> DataFrame:
    """The given columns, and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for p in pieces(batches, len(columns)):
            s = shared.value.scores(*text_buffers(p.column(len(columns))))
            yield pa.RecordBatch.from_arrays([*p.columns[: len(columns)], pa.array(s, pa.float64())], names=[*columns, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return arrow_map(docs.select(*(F.col(f"`{c}`") for c in columns), F.col(text_col)), run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "score double"]))


def toxicity_report(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", sample=SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    s = score(docs, fit(docs, labels, sample, id_col, text_col), [id_col], text_col)
    return s.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", threshold=0.5, sample=SAMPLE) -> DataFrame:
    """The documents that score below threshold, with all their columns."""
    model = fit(docs, labels, sample, id_col, text_col)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col(text_col).alias("__text"))
    return score(whole, model, ["__doc"], "__text").where(F.col("score") < threshold).select("__doc.*")

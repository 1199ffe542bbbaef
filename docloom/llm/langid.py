"""Language identification by a linear-chain conditional random field over words.

Every word (maximal run of letters, lower-cased) has affix features (first and last one to three
letters), letter n-grams, its own identity, and membership in the lexicons of the labels, the most
frequent words of each in the sample. Emission scores are sums of weights of hashed features;
transitions between neighbouring words are learned with them by gradient steps on the exact
likelihood. Documents carry one label, so training sequences are spliced from spans of differently
labelled documents: the chain learns how often languages switch. Forward-backward over all words of
a text gives each its label distribution in code-switched text; a document's label is the one of
largest summed probability and its score the mean of that probability. Long texts are worked on in
stretches side by side: products of the transfer matrices of stretches carry the forward and
backward messages across, so the result is that of one chain, whatever the length of a stretch.

The model is fitted on a bounded sample, documented below; counts per label and predictions cover all
rows and whole texts. Words are scored once per distinct word of a slice. No shuffle of texts.

Defined results: null texts and texts without a letter are `und` with score 0, as is all where no
row has a label to learn from; ties go to the label first in code-point order; a null id belongs to
the fold of the empty text; repeated rows give one row each; a very long text is one chain
like any other; an empty table gives no rows; other columns are ignored by predict and kept by mark, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.frames import fresh, map_texts, pick, with_columns
from docloom.llm.words import U64, _powers, mix

#: The sample: documents of a label at most (in expectation), of all labels (exactly), and characters taken from each, at a hashed place.
PER_LABEL, SAMPLE, CHARS = 300, 4000, 400
#: Hashed features, words of a stretch, lexicon words of a label, gradient steps, folds and the one held out.
FEATURES, SEGMENT, LEXICON, STEPS, FOLDS, HELD = 1 << 16, 128, 400, 60, 4, 2


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Tokens:
    """Words of texts over code points: start, end, hash; each text's range; distinct words."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        code = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
        off = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
        inside = _letters()[code]
        begins = off[:-1][off[:-1] < len(code)]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        first[begins] = inside[begins]
        closing = begins[begins > 0] - 1
        last[:-1] &= ~inside[1:]
        last[closing] = inside[closing]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, off)
        up, self.down = _powers(1 << max(16, int(len(code) + 1).bit_length()))
        self.sum = np.zeros(len(code) + 1, U64)
        np.cumsum(mix(code.astype(U64) + U64(1)) * up[: len(code)], out=self.sum[1:])
        self.hash = self.sub(self.start, self.end, 0)
        self.words, one, self.of = np.unique(self.hash, return_index=True, return_inverse=True)
        self.s, self.e = self.start[one], self.end[one]

    def sub(self, s: np.ndarray, e: np.ndarray, salt: int) -> np.ndarray:
        """Hashes of stretches of code points, wherever they stand."""
        return mix((self.sum[e] - self.sum[s]) * self.down[s] + U64(0x632BE59BD9B4E019 * (salt + 1) % (1 << 64)))

    def features(self, size: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct words: word number, feature, value; sorted by word."""
        s, e, n = self.s, self.e, len(self.s)
        row, feat, val = [np.arange(n)], [self.sub(s, e, 9)], [np.ones(n, np.float32)]
        for k in (1, 2, 3):
            row += [np.arange(n)] * 2
            feat += [self.sub(s, np.minimum(s + k, e), k), self.sub(np.maximum(e - k, s), e, 10 + k)]
            val += [np.ones(n, np.float32)] * 2
        for k in (1, 2, 3):
            m = np.maximum(e - s - k + 1, 0)
            r = np.repeat(np.arange(n), m)
            at = s[r] + np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m)
            row.append(r)
            feat.append(self.sub(at, at + k, 20 + k))
            val.append((2.0 / np.sqrt(m[r])).astype(np.float32))
        row, feat, val = np.concatenate(row), np.concatenate(feat), np.concatenate(val)
        order = np.argsort(row, kind="stable")
        return row[order], (feat[order] % U64(size)).astype(np.int64), val[order]


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    lexicon: list[np.ndarray] = field(default_factory=list)
    lexical: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def member(self, words: np.ndarray) -> np.ndarray:
        return np.stack([np.isin(words, x) for x in self.lexicon], axis=1).astype(np.float32)

    def emissions(self, t: Tokens) -> np.ndarray:
        row, feat, val = t.features(len(self.weights))
        starts = np.searchsorted(row, np.arange(len(t.words)))
        return np.add.reduceat(self.weights[feat] * val[:, None], starts, axis=0) + self.member(t.words) @ self.lexical

    def marginals(self, t: Tokens) -> np.ndarray:
        """For every word of the texts its distribution over the labels."""
        return whole_chain(self.emissions(t)[t.of], t.bounds, self.move, self.first)


def segments(bounds: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of runs of at most `size` consecutive words of one text."""
    n = np.diff(bounds)
    k = -(-n // size)
    doc = np.repeat(np.arange(len(n)), k)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    return bounds[:-1][doc] + part * size, np.minimum(size, n[doc] - part * size)


def chain(score: np.ndarray, start: np.ndarray, length: np.ndarray, move: np.ndarray, first: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all segments at once: word marginals, expected transitions, log likelihood's normaliser.

    enter, leave: for each segment the weights of its first word's labels, and the message that comes back to its last.
    """
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    begin = np.exp(first) if enter is None else enter[order]
    after = None if leave is None else leave[order]
    top = score.max(axis=1, keepdims=True) if len(score) else score[:, :1]
    e, m, labels = np.exp(score - top), np.exp(move), score.shape[1]
    alpha, beta, norm = np.empty_like(e), np.empty_like(e), np.ones(len(e), e.dtype)
    most = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(most), "left")  # segments longer than t
    for t in range(most):
        at = start[: active[t]] + t
        a = e[at] * (begin if t == 0 else alpha[at - 1] @ m)
        norm[at] = a.sum(axis=1)
        alpha[at] = a / norm[at][:, None]
    pairs = np.zeros((labels, labels))
    for t in range(most - 1, -1, -1):
        at = start[: active[t]] + t
        ends = length[: active[t]] == t + 1
        b = np.ones((len(at), labels), e.dtype) if after is None else after[: active[t]].astype(e.dtype)
        inner = at[~ends]
        nxt = e[inner + 1] * beta[inner + 1] / norm[inner + 1][:, None]
        b[~ends] = nxt @ m.T
        beta[at] = b
        pairs += (alpha[inner].T @ nxt) * m
    return alpha * beta, pairs, float(np.log(norm).sum() + top.sum())


def whole_chain(score: np.ndarray, bounds: np.ndarray, move: np.ndarray, first: np.ndarray, size: int = SEGMENT) -> np.ndarray:
    """Word marginals of one chain a text, computed over segments of at most `size` words."""
    start, length = segments(bounds, size)
    text = np.searchsorted(bounds, start, "right") - 1
    head = start == bounds[text]
    n, labels = len(start), score.shape[1]
    if head.all():
        return chain(score, start, length, move, first)[0]
    e, m = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64), np.exp(move)
    # of segments of texts that have several: the product of their words' matrices, up to a factor
    many = np.flatnonzero(~head | np.append(~head[1:], False))
    s, z = start[many], length[many]
    transfer = np.where(head[many][:, None, None], np.eye(labels), m) * e[s][:, None, :]
    for t in range(1, int(z.max())):
        on = np.flatnonzero(z > t)
        step = (transfer[on] @ m) * e[s[on] + t][:, None, :]
        transfer[on] = step / step.sum(axis=(1, 2), keepdims=True)
    place = np.full(n, -1)
    place[many] = np.arange(len(many))
    enter, leave = np.tile(np.exp(first), (n, 1)), np.ones((n, labels))
    tail = np.append(head[1:], True)
    nth = np.arange(n) - np.maximum.accumulate(np.where(head, np.arange(n), 0))  # of its text
    by = np.argsort(nth, kind="stable")
    steps = np.split(by, np.cumsum(np.bincount(nth))[:-1])
    before = enter.copy()  # the message of the last word before a segment
    for k in steps[1:]:
        x = np.einsum("ij,ijk->ik", before[k - 1], transfer[place[k - 1]])
        before[k] = x / x.sum(axis=1, keepdims=True)
        enter[k] = before[k] @ m
    for k in reversed(steps):
        k = k[~tail[k]]
        x = np.einsum("ijk,ik->ij", transfer[place[k + 1]], leave[k + 1])
        leave[k] = x / x.max(axis=1, keepdims=True)
    p = chain(score, start, length, move, first, enter, leave)[0]
    return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 11) -> Crf | None:
    """A model from texts and labels, by Adam on the penalised likelihood of spliced sequences."""
    labels = sorted({y for _, y in rows})
    t = Tokens([x for x, _ in rows])
    if not labels or not len(t.words):
        return None
    gold_of = np.array([labels.index(y) for _, y in rows])
    rng, n = np.random.default_rng(seed), len(labels)
    # spans of 3 to 20 words, shuffled and joined to sequences
    spans = []
    for d, (a, z) in enumerate(zip(t.bounds[:-1], t.bounds[1:], strict=True)):
        while a < z:
            k = int(rng.integers(3, 21))
            spans.append((a, min(a + k, z), d))
            a += k
    spans = [spans[i] for i in rng.permutation(len(spans))]
    word = np.concatenate([t.of[a:z] for a, z, _ in spans])
    gold = np.concatenate([np.full(z - a, gold_of[d]) for a, z, d in spans])
    start, length = segments(np.array([0, len(word)]), 64)
    lexicon = []
    for y in range(n):
        count = np.bincount(word[gold == y], minlength=len(t.words))
        best = np.lexsort((t.words, -count))[:LEXICON]
        lexicon.append(np.sort(t.words[best[count[best] > 1]]))
    model = Crf(labels, np.zeros((FEATURES, n), np.float32), lexicon, np.zeros((n, n), np.float32), np.zeros((n, n)), np.zeros(n))
    row, feat, val = t.features()
    by_word = np.searchsorted(row, np.arange(len(t.words)))
    order = np.argsort(feat, kind="stable")
    used, by_feat = np.unique(feat[order], return_index=True)
    member = model.member(t.words)
    truth = np.zeros((len(word), n), np.float32)
    truth[np.arange(len(word)), gold] = 1
    seen = np.zeros((n, n))
    inner = np.ones(len(word), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    np.add.at(seen, (gold[at - 1], gold[at]), 1)
    params = [np.zeros((len(used), n), np.float32), model.lexical, model.move, model.first]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        model.weights[used] = params[0]
        score = np.add.reduceat(model.weights[feat] * val[:, None], by_word, axis=0) + member @ params[1]
        got, pairs, _ = chain(score[word], start, length, params[2], params[3])
        diff = got - truth
        word_grad = np.stack([np.bincount(word, diff[:, y], len(t.words)) for y in range(n)], axis=1).astype(np.float32)
        flat = word_grad[row[order]] * val[order][:, None]
        grads = [np.add.reduceat(flat, by_feat, axis=0), member.T @ word_grad, pairs - seen, diff[start].sum(axis=0)]
        for i, (p, g) in enumerate(zip(params, grads, strict=True)):
            g = g / len(word) + 2e-6 * p
            m1, m2 = moments[i]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    model.weights[used] = params[0]
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def sample(docs: DataFrame, per_label: int = PER_LABEL, most: int = SAMPLE, chars: int = CHARS) -> list[tuple[str, str]]:
    """The bounded training sample: labels are counted over all rows; hashes pick rows and places. Columns doc_id, text, lang."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count()
    labels = counts.orderBy(F.desc("count"), "lang").limit(most).collect()
    if not labels:
        return []
    each = min(per_label, max(1, most // len(labels)))
    rate = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, min(1.0, each / r["count"])) for r in labels], "lang string, rate double"))
    h = F.xxhash64("doc_id", "text")
    place = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - chars + 1, F.lit(1)).cast("long")) + 1).cast("int")
    taken = known.join(rate, "lang").where(F.pmod(h, F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    rows = taken.select("lang", F.substring(F.col("text"), place, F.lit(chars)).alias("text"), h.alias("h")).orderBy("h", "lang").limit(most).collect()
    return [(r.text, r.lang) for r in rows]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Crf | None:
    return fit(sample(pick(docs, doc_id=(doc_id, "string"), text=(text, "string"), lang=(lang, "string"))))


def mark(docs: DataFrame, model: Crf | None, text: str = "text", name: str = "language") -> tuple[DataFrame, str]:
    """All columns of docs and one struct more, lang and score; and its name."""
    name = fresh(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = Tokens(batch.column(batch.schema.get_field_index(text)).to_pylist())
        lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
        if shared.value is not None and len(t.words):
            p = shared.value.marginals(t).astype(np.float64)
            total = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)))
            per = total[t.bounds[1:]] - total[t.bounds[:-1]]
            n = np.diff(t.bounds)
            best = per.argmax(axis=1)
            score = np.clip(per[np.arange(len(per)), best] / np.maximum(n, 1), 0, 1)
            lang = [shared.value.labels[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)]
        return with_columns(batch, **{name: pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], fields=list(kind))})

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType.fromDDL("lang string, score double"))])
    return map_texts(docs, text, run, schema, 1 << 18), name


def predict(docs: DataFrame, model: Crf | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, for each row of docs."""
    marked, name = mark(pick(docs, doc_id=(doc_id, "bigint"), text=(text, "string")), model)
    return marked.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name)["lang"].alias("lang_pred"), F.col(name)["score"].alias("score"))

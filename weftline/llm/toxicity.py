"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is a row of overlapping windows of words. A word enters by its own vector and by the vectors of its character
n-grams, so that inflected forms of an unseen word are known by their parts. Two gated recurrent passes read a window,
attention pools their states, and a text is as toxic as its worst window. All windows of all texts are scored.

Labels mark texts, not windows. Training therefore takes turns: the present network finds each training text's worst
windows, then it learns from these. The vectors start from the log-odds of words and n-grams in the training texts.
The fit uses a bounded sample of labelled rows (EACH_CLASS texts of either label, TRAIN_WORDS words in all).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import ship

#: Words of a window and between the starts of two; units of each direction; sizes of both input vectors.
WINDOW, STRIDE, UNITS, DIM, ATTEND = 32, 26, 6, 8, 6
#: Character n-grams with the word's edges marked, dealt to so many buckets.
NGRAMS, BUCKETS = (3, 4, 5), 1 << 15
#: Texts of the training sample per label, its words in all, and words that have a vector of their own (by frequency).
EACH_CLASS, TRAIN_WORDS, VOCABULARY, LEAST_TEXTS = 2_000, 2_500_000, 30_000, 4
#: Turns of finding windows and learning, passes over the windows in a turn, windows per step and per clean text, steps of a turn at least.
TURNS, PASSES, STEP, HARDEST, RATE, LEAST_STEPS = 4, 2, 128, 2, 0.015, 50
#: Log-likelihood, in nats, by which chance is taken to fall short of its bound, and over which evidence comes to count in full.
CHANCE, FULL = 2.0, 5.0
#: Words that a worker remembers, and their characters in all; texts, bytes of texts and windows that it takes at once.
MEMO_WORDS, MEMO_CHARS, AT_ONCE, BYTES_AT_ONCE, CHUNK = 300_000, 8_000_000, 512, 8_000_000, 1024
EDGES = ".,;:!?\"'()[]{}<>*_-"

_models: dict[str, Scorer] = {}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def core(word: str) -> str:
    """The word without marks at its edges; marks alone stay as they are."""
    return word.strip(EDGES) or word


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different lower-case words of some texts, the numbers of these in text order, and each text's number of words."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    names, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in names:  # white space at an end of a text
        none = names.index("")
        real = codes != none
        lengths = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(lengths)])])
        codes = codes[real]
        codes -= codes > none
        del names[none]
    return names, codes, lengths


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams in turn, and where each word's begin. Every word has one n-gram at least."""
    marked = ["\x02" + w + "\x03" for w in words]
    lengths = np.array([len(m) for m in marked])
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner, left = np.repeat(np.arange(len(words)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))
    whose, buckets = [], []
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E37_79B9_7F4A_7C15) + code[at + k]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58_476D_1CE4_E5B9)
        whose.append(owner[at])
        buckets.append((h >> np.uint64(49)).astype(np.int64))
    whose, buckets = np.concatenate(whose), np.concatenate(buckets)
    order = np.argsort(whose, kind="stable")
    return buckets[order], np.searchsorted(whose[order], np.arange(len(words)))


def window_counts(lengths: np.ndarray) -> np.ndarray:
    """Windows of texts of so many words: they begin STRIDE words apart and together cover all words; one at least."""
    return 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))


@dataclass
class Network:
    """Weights. ``words`` and ``grams`` are input vectors; row 0 of ``words`` stands for words without one."""

    vocabulary: dict[str, int]
    words: np.ndarray
    grams: np.ndarray
    inputs: np.ndarray  # 2 x 2 DIM x 3 UNITS, by direction
    bias: np.ndarray  # 2 x 1 x 3 UNITS
    state: np.ndarray  # 2 x UNITS x 3 UNITS
    attend: np.ndarray  # 2 UNITS x ATTEND
    focus: np.ndarray  # ATTEND
    out: np.ndarray  # 2 UNITS
    level: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))

    TRAINED = ("words", "grams", "inputs", "bias", "state", "attend", "focus", "out", "level")

    @staticmethod
    def fresh(vocabulary: dict[str, int], rng: np.random.Generator) -> Network:
        def draw(*shape, scale=0.1):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        h = UNITS
        return Network(
            vocabulary, draw(len(vocabulary) + 1, DIM, scale=0.02), draw(BUCKETS, DIM, scale=0.02), draw(2, 2 * DIM, 3 * h, scale=0.3), np.zeros((2, 1, 3 * h), np.float32),
            draw(2, h, 3 * h, scale=0.3), draw(2 * h, ATTEND, scale=0.3), draw(ATTEND, scale=0.3), draw(2 * h, scale=0.3),
        )

    def vectors(self, rows: np.ndarray, buckets: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Inputs of words: own vector, and the n-grams' sum over the root of their number."""
        chars = np.add.reduceat(self.grams[buckets], starts, axis=0) if len(starts) else np.zeros((0, DIM), np.float32)
        return np.concatenate([self.words[rows], chars / np.sqrt(counts, dtype=np.float32)[:, None]], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Inputs' share in the gates, 2 x words x 3 UNITS, with a last row for the room after a short text."""
        return np.concatenate([x @ self.inputs + self.bias, np.zeros((2, 1, 3 * UNITS), np.float32)], axis=1)

    def forward(self, inputs, room: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of each window. ``inputs(t)``: gate inputs of the t-th step, where the second direction starts at
        the end; ``room``: windows x WINDOW, true where no word is; ``keep`` gets what the way back needs."""
        n, u = len(room), UNITS
        h = np.zeros((2, n, u), np.float32)
        states = np.empty((n, WINDOW, 2 * u), np.float32)
        for t in range(WINDOW):
            x, g = inputs(t), h @ self.state
            rz = _sigmoid(x[:, :, : 2 * u] + g[:, :, : 2 * u])
            r, z = rz[:, :, :u], rz[:, :, u:]
            new = np.tanh(x[:, :, 2 * u :] + r * g[:, :, 2 * u :])
            before, h = h, new + z * (h - new)
            states[:, t, :u], states[:, WINDOW - 1 - t, u:] = h[0], h[1]
            if keep is not None:
                keep.append((before, r, z, new, g[:, :, 2 * u :]))
        looked = np.tanh(states.reshape(-1, 2 * u) @ self.attend)
        e = (looked @ self.focus).reshape(n, WINDOW)
        e[room] = -1e9
        e = np.exp(e - e.max(axis=1, keepdims=True))
        a = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,ntk->nk", a, states)
        if keep is not None:
            keep += [states, looked, a, pooled]
        return pooled @ self.out + self.level

    def forward_ids(self, gates: np.ndarray, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of each window of rows of ``gates``, of which the last is the room after a short text."""
        return self.forward(lambda t: np.stack([gates[0].take(ids[:, t], axis=0), gates[1].take(ids[:, WINDOW - 1 - t], axis=0)]), ids == gates.shape[1] - 1, keep)

    def backward(self, x: np.ndarray, ids: np.ndarray, keep: list, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Slopes of the weights, and of the input vectors ``x``, given those of the logits."""
        *steps, states, looked, a, pooled = keep
        n, u = len(ids), UNITS
        d = {"out": pooled.T @ slope, "level": slope.sum(keepdims=True)}
        d_pooled = slope[:, None] * self.out
        d_a = np.einsum("ntk,nk->nt", states, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(axis=1, keepdims=True))
        d["focus"] = looked.T @ d_e.ravel()
        d_look = d_e.reshape(-1, 1) * self.focus * (1 - looked * looked)
        d["attend"] = states.reshape(-1, 2 * u).T @ d_look
        d_states = a[:, :, None] * d_pooled[:, None, :] + (d_look @ self.attend.T).reshape(n, WINDOW, 2 * u)
        d_gates = np.zeros((2, len(x) + 1, 3 * u), np.float32)
        d["state"], d_h = np.zeros_like(self.state), np.zeros((2, n, u), np.float32)
        for t in reversed(range(WINDOW)):
            before, r, z, new, g_new = steps[t]
            d_h += np.stack([d_states[:, t, :u], d_states[:, WINDOW - 1 - t, u:]])
            d_new = d_h * (1 - z) * (1 - new * new)
            d_z = d_h * (before - new) * z * (1 - z)
            d_r = d_new * g_new * r * (1 - r)
            for way, at in enumerate((t, WINDOW - 1 - t)):
                np.add.at(d_gates[way], ids[:, at], np.concatenate([d_r[way], d_z[way], d_new[way]], axis=1))
            d_g = np.concatenate([d_r, d_z, d_new * r], axis=2)
            d["state"] += before.transpose(0, 2, 1) @ d_g
            d_h = d_h * z + d_g @ self.state.transpose(0, 2, 1)
        d_gates = d_gates[:, :-1]
        d["bias"] = d_gates.sum(axis=1, keepdims=True)
        d["inputs"] = x.T @ d_gates
        return d, (d_gates @ self.inputs.transpose(0, 2, 1)).sum(axis=0)


class Scorer:
    """A network with a memory of the gate inputs of words met before."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.gates = np.zeros((2, 1024, 3 * UNITS), np.float32)

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            cores = [core(w) for w in part]
            buckets, starts = ngram_buckets(cores)
            counts = np.diff(np.append(starts, len(buckets)))
            rows = np.array([self.net.vocabulary.get(c, 0) for c in cores])
            fresh = self.net.gates(self.net.vectors(rows, buckets, starts, counts))[:, :-1]
            first = len(self.known) + 1  # row 0 is the room after a short text
            while first + len(part) > self.gates.shape[1]:
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)], axis=1)
            self.gates[:, first : first + len(part)] = fresh
            self.known.update(zip(part, range(first, first + len(part)), strict=True))
            self.chars += sum(map(len, part))

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        names, codes, lengths = words_of(texts)
        if len(self.known) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self._forget()
        self._learn([w for w in names if w not in self.known])
        return np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[codes], lengths

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of all windows of the texts: logit and text."""
        ids, lengths = self._ids(texts)
        counts = window_counts(lengths)
        # Texts stand in one row, each with room after it (row 0 of the gates) up to a multiple of STRIDE, so that
        # windows are strided views. Blocks of STRIDE words that only end a text's last window start none.
        reach = -(-WINDOW // STRIDE) - 1
        blocks = counts + reach
        base = STRIDE * (np.cumsum(blocks) - blocks)
        flat = np.zeros(STRIDE * (int(blocks.sum()) + reach), np.int64)
        flat[np.arange(len(ids)) + np.repeat(base - (np.cumsum(lengths) - lengths), lengths)] = ids
        many = int(blocks.sum())
        out = np.empty(many, np.float32)
        for k in range(0, many, CHUNK):
            n = min(CHUNK, many - k)
            part = flat[STRIDE * k : STRIDE * (k + n + reach)]
            both = self.gates[0].take(part, axis=0).reshape(n + reach, STRIDE, -1), self.gates[1].take(part, axis=0).reshape(n + reach, STRIDE, -1)
            room = np.lib.stride_tricks.sliding_window_view(part == 0, WINDOW)[::STRIDE][:n]
            x = np.empty((2, n, 3 * UNITS), np.float32)

            def step(t: int, both=both, x=x, n=n) -> np.ndarray:
                for way, at in enumerate((t, WINDOW - 1 - t)):
                    first = at // STRIDE
                    x[way] = both[way][first : first + n, at % STRIDE]
                return x

            out[k : k + n] = self.net.forward(step, room)
        real = np.arange(many) - np.repeat(np.cumsum(blocks) - blocks, blocks) < np.repeat(counts, blocks)
        return out[real], np.repeat(np.arange(len(lengths)), counts)

    def scores(self, texts) -> np.ndarray:
        """The worst window of each text, 0 to 1; a text without words is one empty window."""
        logit, owner = self.logits(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        worst = np.full(len(texts), -np.inf, np.float64)
        np.maximum.at(worst, owner, logit)
        return 1 / (1 + np.exp(-worst))


class _Adam:
    def __init__(self, net: Network):
        self.net, self.t = net, 0
        self.m = {k: np.zeros_like(getattr(net, k)) for k in Network.TRAINED}
        self.v = {k: np.zeros_like(getattr(net, k)) for k in Network.TRAINED}

    def step(self, slopes: dict[str, tuple[np.ndarray | None, np.ndarray]], rate: float) -> None:
        """``slopes``: rows (None: all) and their slopes. Rows of a table that a step does not touch stay as they are."""
        self.t += 1
        for k, (rows, d) in slopes.items():
            at = slice(None) if rows is None else rows
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * d
            v = self.v[k][at] = 0.99 * self.v[k][at] + 0.01 * d * d
            getattr(self.net, k)[at] -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)


def _log_odds(hits: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Per column of a count pair (clean texts with it, toxic texts with it): smoothed log-odds, 0 where chance explains it.

    A column counts as far as its log-likelihood ratio against the common share exceeds what the best of so many
    columns reaches by chance (the logarithm of their number, less CHANCE), in full from FULL above that.
    """
    clean, bad = hits
    n0, n1 = (toxic == 0).sum(), (toxic == 1).sum()
    n, share = np.maximum(clean + bad, 1), n1 / (n0 + n1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num(bad * np.log(bad / (n * share))) + np.nan_to_num(clean * np.log(clean / (n * (1 - share))))
    many = max(2, int((clean + bad > 0).sum()))
    sure = np.clip((ratio - np.log(many) + CHANCE) / FULL, 0, 1)
    return sure * (np.log((bad + 1) / (n1 + 2)) - np.log((clean + 1) / (n0 + 2)))


def train(texts: list[str], toxic: np.ndarray, seed: int = 11) -> Network:
    """A network fitted to labelled texts. With one label only it says that label's share for everything."""
    rng = np.random.default_rng(seed)
    seen, codes, lengths = words_of(pa.array(texts, pa.string()))
    names = sorted({core(w) for w in seen})
    number = {c: i for i, c in enumerate(names)}
    docs = np.split(np.array([number[core(w)] for w in seen], np.int64)[codes], np.cumsum(lengths)[:-1]) if texts else []
    buckets, starts = ngram_buckets(names) if names else (np.empty(0, np.int64), np.empty(0, np.int64))
    counts = np.diff(np.append(starts, len(buckets)))
    in_texts, gram_texts = np.zeros((2, len(names))), np.zeros((2, BUCKETS))
    for y, ids in zip(toxic, docs, strict=True):
        own = np.unique(ids)
        in_texts[y, own] += 1
        if len(own):
            gram_texts[y, np.unique(buckets[_spread(starts[own], counts[own])])] += 1
    often = in_texts.sum(axis=0)
    chosen = [int(i) for i in np.lexsort((np.arange(len(names)), -often))[:VOCABULARY] if often[i] >= LEAST_TEXTS]
    net = Network.fresh({names[i]: k + 1 for k, i in enumerate(chosen)}, rng)
    share = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.1
    net.level[:] = np.log(share / (1 - share))
    if len(set(toxic.tolist())) < 2:
        net.out[:] = 0
        return net
    word_odds, gram_odds = _log_odds(in_texts, toxic), _log_odds(gram_texts, toxic)
    net.words[1:, 0] = 0.3 * word_odds[chosen]
    net.grams[:, 0] = 0.3 * gram_odds
    # What chance explains is no feature: it keeps a zero vector, so no text is learnt by heart through its rare words.
    live = {"words": np.append(False, word_odds[chosen] != 0), "grams": gram_odds != 0}
    net.words[~live["words"]], net.grams[~live["grams"]] = 0, 0
    row = np.zeros(len(names), np.int64)
    row[chosen] = np.arange(1, len(chosen) + 1)
    where = [(STRIDE * np.arange(n)).tolist() for n in window_counts(lengths)]
    hint = np.add.reduceat(gram_odds[buckets], starts) / np.sqrt(counts) + word_odds * (row > 0) if len(names) else np.zeros(0)
    room, adam = len(names), _Adam(net)
    hint = np.append(hint, -np.inf)
    for turn in range(TURNS):
        if turn == 0:  # the windows of the most suspect words
            ranks = [np.array([hint[_window(ids, s, room)].max() for s in w]) for ids, w in zip(docs, where, strict=True)]
        else:
            gates = net.gates(net.vectors(row, buckets, starts, counts))
            ranks = _ranks(net, gates, docs, where, room)
        windows, label = [], []
        for ids, w, y, r in zip(docs, where, toxic, ranks, strict=True):
            best = np.argsort(-r, kind="stable")[: 1 if y else HARDEST]
            windows += [_window(ids, w[b], room) for b in best]
            label += [y] * len(best)
        windows, label = np.array(windows), np.array(label, np.float32)
        weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
        passes = max(PASSES, -(-LEAST_STEPS * STEP // len(windows)))
        for passed in range(passes):
            order = rng.permutation(len(windows))
            rate = RATE * 0.7 ** (turn + passed / passes)
            for k in range(0, len(order), STEP):
                _learn_step(net, adam, windows[order[k : k + STEP]], label[order[k : k + STEP]], weight[order[k : k + STEP]], row, buckets, starts, counts, room, rate, live)
    return net


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)


def _window(ids: np.ndarray, start: int, room: int) -> np.ndarray:
    part = ids[start : start + WINDOW]
    return part if len(part) == WINDOW else np.concatenate([part, np.full(WINDOW - len(part), room)])


def _ranks(net: Network, gates: np.ndarray, docs: list[np.ndarray], where: list[list[int]], room: int) -> list[np.ndarray]:
    """Logits of each text's windows."""
    out, held, size = [], [], 0
    flat: list[np.ndarray] = []

    def close():
        logits = net.forward_ids(gates, np.array(flat))
        out.extend(np.split(logits, np.cumsum(held)[:-1]))
        flat.clear()
        held.clear()

    for ids, w in zip(docs, where, strict=True):
        flat += [_window(ids, s, room) for s in w]
        held.append(len(w))
        size += len(w)
        if size >= 4096:
            close()
            size = 0
    if flat:
        close()
    return out


def _learn_step(net, adam, windows, label, weight, row, buckets, starts, counts, room, rate, live) -> None:
    used, ids = np.unique(np.append(windows, room), return_inverse=True)
    ids, used = ids[:-1].reshape(windows.shape), used[:-1]  # the room is the greatest number, so the last row
    at = _spread(starts[used], counts[used]) if len(used) else np.empty(0, np.int64)
    own, n = buckets[at], counts[used]
    x = net.vectors(row[used], own, np.cumsum(n) - n, n)
    keep: list = []
    p = _sigmoid(net.forward_ids(net.gates(x), ids, keep))
    slopes, d_x = net.backward(x, ids, keep, ((p - label) * weight / len(label)).astype(np.float32))
    table = {k: (None, v.astype(np.float32)) for k, v in slopes.items()}
    rows, back = np.unique(row[used], return_inverse=True)
    d_words = np.zeros((len(rows), DIM), np.float32)
    np.add.at(d_words, back, d_x[:, :DIM])
    grams, back = np.unique(own, return_inverse=True)
    d_grams = np.zeros((len(grams), DIM), np.float32)
    np.add.at(d_grams, back, np.repeat(d_x[:, DIM:] / np.sqrt(n, dtype=np.float32)[:, None], n, axis=0))
    words_on, grams_on = live["words"][rows], live["grams"][grams]
    adam.step(table | {"words": (rows[words_on], d_words[words_on]), "grams": (grams[grams_on], d_grams[grams_on])}, rate)


def held_out(doc_id):
    """Rows kept from training: crc32 of the doc_id as text leaves 0 when divided by 5; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(documents: DataFrame, labels: DataFrame, each: int = EACH_CLASS, most_words: int = TRAIN_WORDS) -> tuple[list[str], np.ndarray]:
    """A bounded sample of labelled texts, the same in every run: ``each`` doc_ids of either label by hash.

    A doc_id with several labels counts as toxic if one says so; null labels and doc_ids are left out, and so are
    rows that are held out. Texts above an even share of ``most_words`` (taken as 8 bytes each) are not sampled.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).filter(~held_out("doc_id"))
    longest = 64 * 8 * most_words // (2 * each)
    sizes = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("_bytes")).filter(F.col("_bytes").between(1, longest)).distinct()
    able = known.join(sizes, "doc_id").withColumn("_order", F.xxhash64("doc_id"))
    picked = [(nth, r) for y in (0, 1) for nth, r in enumerate(able.filter(F.col("toxic") == y).orderBy("_order", "doc_id", "_bytes").limit(each).collect())]  # 2 * each narrow rows
    left, wanted = 8 * most_words, []
    for _, r in sorted(picked, key=lambda x: (x[0], x[1]["toxic"])):
        left -= r["_bytes"]
        if left < 0:
            break
        wanted.append((r["doc_id"], r["_bytes"], r["toxic"]))
    if not wanted:
        return [], np.empty(0, np.int64)
    few = documents.sparkSession.createDataFrame(wanted, "doc_id long, _bytes int, toxic int")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length("text").alias("_bytes")).join(F.broadcast(few), ["doc_id", "_bytes"])
    got = rows.groupBy("doc_id", "_bytes", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id", "_bytes").toArrow()
    return got.column("text").to_pylist(), np.array(got.column("toxic").to_pylist(), np.int64)


def _scoring(net: Network, key: str):
    def work(batches):
        if key not in _models:
            _models.clear()
            _models[key] = Scorer(net)
        scorer = _models[key]
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).cumsum()
            at = 0
            while at < batch.num_rows:
                within = int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES_AT_ONCE, "right"))
                part = batch.slice(at, max(1, min(AT_ONCE, within - at)))
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scorer.scores(part.column(part.num_columns - 1)), pa.float64())], [*part.schema.names[:-1], "score"])

    return work


def score_documents(documents: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``documents`` without the text but with ``score`` (double): the worst window's probability of being toxic.

    Null and empty texts are scored as one empty window. A column named score is replaced. No shuffle.
    """
    import uuid

    ship(documents.sparkSession)
    narrow = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in (text, "score")], F.col(text).alias("_text"))
    schema = narrow.drop("_text").withColumn("score", F.lit(0.0)).schema
    return narrow.mapInArrow(_scoring(net, uuid.uuid4().hex), schema)


def toxicity_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labels that are not held out and scores every document, empty and null texts too.

    Repeated rows are scored each and null doc_ids are not held out; texts of any length are scored in all their
    windows; without labels every text has one score; an empty table gives no rows. Other columns are not read.
    """
    net = train(*training_sample(documents.select("doc_id", "text"), labels))
    found = score_documents(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), net)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

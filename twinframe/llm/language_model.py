"""Language-model scores from a log-bilinear model (operator 5).

Tokens are ASCII-lower-cased words and an end token after each document. The model's units are all
words that occur ``least`` times or more (at least the ``frequent`` commonest), the end token, and
``classes`` classes of the rarer words, by their first two bytes and whether they end in a letter or
digit; a word of a class has its share of the class by its count, plus a half for each word and for
one unknown word. ``least`` is 20, and a hundredth of the square root of the training tokens where
that is more, so the units grow with the corpus, more slowly than its words. A unit's probability
after the two units before it comes from a log-bilinear model (Mnih and Hinton 2007): each context
position has its own vector for each unit, their sum is the predicted vector, and its inner products
with the units' vectors plus a bias are the scores. The softmax is factored: units in order of
frequency make about as many groups as a group has units; groups have vectors of their own, and a
unit's probability is its group's among the groups times its own among the group's units.

Counts are made over all training documents. Training is noise-contrastive estimation in numpy
(Mnih and Teh 2012): a short warm start on the driver on at most ``warm`` documents with the
smallest hashes, then one pass over all training documents on the cluster, each task from the same
start, whose parameters are averaged by their uses, vector by vector, in one aggregation; a vector
that no task used keeps its start. There is one task a core, since each returns parameters. Only the
parameters (units x ``dim``), never data, come back to the driver.

Words are cut and looked up in Arrow. A score is a sum over the two context places, so the sums of
a softmax are inner products of one exponentiated vector a place; they are made once for each unit
that a block's contexts share, or else as batched matrix products, group by group. Counts of the ``head`` commonest words and of
all units are broadcast; the counts of all other words come by a join, from which each document's
sums are made.

Edge cases. A null text is empty: it has the end token only. A null id is never held out and is
learned from. Repeated rows count and are scored each. Extra columns are ignored. Without training
documents N and V are 0 and every unit is as likely. An empty table gives none.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.sampling import most_frequent, smallest
from twinframe.llm.slices import slices
from twinframe.sources.shared import materialize

#: Stands for the end token in tables of words; no word has white space.
END = b" "
LOG10 = math.log(10.0)


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def split(texts):
    """The words of all texts, one after another, as an Arrow array of binary, and the number of words of each text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, type=pa.binary()), b"").view(pa.string())  # ASCII functions take any bytes
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    sizes, flat = pc.list_value_length(parts).to_numpy().astype(np.int64), parts.flatten()
    full = pc.binary_length(flat).to_numpy() > 0  # white space at an end leaves an empty part
    if not full.all():
        before, ends = np.concatenate(([0], np.cumsum(full))), np.cumsum(sizes)
        flat, sizes = flat.filter(pa.array(full)), before[ends] - before[ends - sizes]
    return flat.view(pa.binary()), sizes


def places(ws, table) -> np.ndarray:
    """The place of each word in a table, -1 if it isn't there."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(ws, value_set=table), -1).to_numpy().astype(np.int32)


def with_ends(of_words: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Numbers of words, with one more after each text's; ``sizes`` counts both."""
    out, is_word = np.full(len(of_words) + len(sizes), end, dtype=of_words.dtype), np.ones(len(of_words) + len(sizes), dtype=bool)
    is_word[np.cumsum(sizes) - 1] = False
    out[is_word] = of_words
    return out


class Units(dict):
    """Numbers of words' units: frequent words, then the end token, then classes; one more only begins documents.

    As a mapping it also remembers other words' classes, up to a bound.
    """

    def __init__(self, frequent: list[bytes], classes: int, remember: int = 200_000):
        import pyarrow as pa

        super().__init__({w: i for i, w in enumerate(frequent)})
        self.classes, self.end, self.remember = classes, len(frequent), remember
        self[END] = self.end
        self.size = self.start = self.end + 1 + classes
        self.table = pa.array([*frequent, END], type=pa.binary())
        # The same classes by tables: of the first two bytes, of a lone byte, and of the last one.
        starts = [bytes((a, b)) for a in range(256) for b in range(256)] + [bytes((a,)) for a in range(256)]
        self.by_start = np.array([zlib.crc32(w) % (classes // 2) * 2 for w in starts], dtype=np.int32)
        self.by_last = np.array([not (bytes((a,)).isalnum() or a > 127) for a in range(256)], dtype=np.int32)

    def __missing__(self, w: bytes) -> int:
        """The class of a word that isn't frequent."""
        u = self.end + 1 + (zlib.crc32(w[:2]) % (self.classes // 2)) * 2 + (not (w[-1:].isalnum() or w[-1] > 127))
        if len(self) < self.remember:
            self[w] = u
        return u

    def __reduce__(self):
        return Units, (list(self)[: self.end], self.classes, self.remember)

    def numbers(self, ws) -> np.ndarray:
        """Units of an Arrow array of words."""
        import pyarrow as pa

        out = places(ws, self.table)
        rare = np.flatnonzero(out < 0)
        if len(rare):
            ws = ws.take(pa.array(rare))
            cuts, data = np.frombuffer(ws.buffers()[1], dtype=np.int32)[ws.offset : ws.offset + len(ws) + 1], np.frombuffer(ws.buffers()[2], dtype=np.uint8)
            first, last = cuts[:-1], cuts[1:] - 1
            start = np.where(last > first, data[first].astype(np.int32) * 256 + data[np.minimum(first + 1, last)], 65536 + data[first].astype(np.int32))
            out[rare] = self.end + 1 + self.by_start[start] + self.by_last[data[last]]
        return out

    def sequence(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Units of all tokens of some texts, and the number of tokens of each text."""
        ws, sizes = split(texts)
        return with_ends(self.numbers(ws), sizes + 1, self.end), sizes + 1

    def context(self, units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units one and two places before each token, within its text."""
        first = np.zeros(len(units), dtype=bool)
        first[np.cumsum(sizes) - sizes] = True
        one = np.concatenate((units[:1], units[:-1]))
        one[first] = self.start
        two = np.concatenate((one[:1], one[:-1]))
        two[first] = self.start
        return one, two


def group_size(n: int) -> int:
    """Units of a group: about the square root of their number; a few make one group."""
    return n if n <= 64 else math.ceil(math.sqrt(n))


class LogBilinear:
    """Unit vectors and biases R (size x dim + 1), context vectors Q1 and Q2 (size + 1 x dim), the groups' vectors and biases."""

    def __init__(self, r: np.ndarray, q1: np.ndarray, q2: np.ndarray, groups: np.ndarray):
        self.r, self.q1, self.q2, self.groups = (np.ascontiguousarray(x, dtype=np.float32) for x in (r, q1, q2, groups))
        self.per = group_size(len(r))

    @classmethod
    def fresh(cls, counts: np.ndarray, dim: int, seed: int = 11) -> LogBilinear:
        rng, n = np.random.RandomState(seed), len(counts)
        p = (counts + 0.5) / (counts + 0.5).sum()
        starts = np.arange(0, n, group_size(n))
        vectors = lambda p: np.concatenate((rng.normal(0, 0.1, (len(p), dim)), np.log(p)[:, None]), axis=1)
        return cls(vectors(p), rng.normal(0, 0.1, (n + 1, dim)), rng.normal(0, 0.1, (n + 1, dim)), vectors(np.add.reduceat(p, starts)))

    def tables(self) -> list[np.ndarray]:
        return [self.r, self.q1, self.q2, self.groups]

    def train(self, target, one, two, noise_p: np.ndarray, noise: int = 24, batch: int = 4096, rate: float = 0.05, seed: int = 5, state=None, used=None):
        """One pass of noise-contrastive estimation with AdaGrad; a batch shares its noise. Returns the optimizer's state.

        ``used`` counts the uses of each table's rows.
        """
        dim, rng, tables = self.q1.shape[1], np.random.RandomState(seed), self.tables()
        state = state or [np.full(x.shape, 0.01, dtype=np.float32) for x in tables]
        group_p = np.add.reduceat(noise_p, np.arange(0, len(noise_p), self.per))
        levels = [(self.r, np.cumsum(noise_p), np.log(noise * noise_p).astype(np.float32)), (self.groups, np.cumsum(group_p), np.log(noise * group_p).astype(np.float32))]

        def contrast(q, t, rows, cdf, log_kp):
            """Gradients of the predicted vectors, and of the rows of targets and noise."""
            k = np.searchsorted(cdf, rng.random_sample(noise) * cdf[-1])
            rt, rk = rows.take(t, axis=0), rows.take(k, axis=0)
            own = np.einsum("ij,ij->i", q, rt[:, :dim])
            own += rt[:, dim]
            own -= log_kp[t]
            false = q @ rk[:, :dim].T
            false += rk[:, dim] - log_kp[k]
            gt, gk = _sigmoid(own), _sigmoid(false)
            gt -= 1
            g = np.empty((len(t) + noise, dim + 1), dtype=np.float32)
            np.multiply(q, gt[:, None], out=g[: len(t), :dim])
            g[: len(t), dim] = gt
            g[len(t) :, :dim] = gk.T @ q
            g[len(t) :, dim] = gk.sum(axis=0)
            gq = gk @ rk[:, :dim]
            gq += rt[:, :dim] * gt[:, None]
            return gq, np.concatenate((t, k)), g

        for at in range(0, len(target), batch):
            t, a, b = target[at : at + batch], one[at : at + batch], two[at : at + batch]
            q = self.q1.take(a, axis=0)
            q += self.q2.take(b, axis=0)
            gq, unit, gr = contrast(q, t, *levels[0])
            changes = [(0, unit, gr)]
            if len(self.groups) > 1:
                gq2, group, gg = contrast(q, t // self.per, *levels[1])
                gq += gq2
                changes.append((3, group, gg))
            scale = np.float32(1 / math.sqrt(len(t)))
            for i, index, g in (*changes, (1, a, gq), (2, b, gq)):
                rows, uses, g = _by_row(index, g)
                g *= scale
                s, x = state[i].take(rows, axis=0), tables[i].take(rows, axis=0)
                s += g * g
                state[i][rows] = s
                np.sqrt(s, out=s)
                g /= s
                g *= np.float32(rate)
                x -= g
                tables[i][rows] = x
                if used is not None:
                    used[i][rows] += uses
        return state

    def log_probability(self, target, one, two, at_once: int = 256, block: int = 1 << 20) -> np.ndarray:
        """Natural log of each target's normalised probability after its context, in blocks of bounded size."""
        parts = [self._log_probability(*(x[i : i + block].astype(np.int64) for x in (target, one, two)), at_once) for i in range(0, len(target), block)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _log_probability(self, target, one, two, at_once: int) -> np.ndarray:
        """What tokens share is made once: a context's groups, and a context's units of one group."""
        n = len(self.q2)
        context, at = _distinct(one * n + two)
        first, second = np.divmod(context, n)
        out, group, several = np.empty(len(target)), target // self.per, len(self.groups) > 1
        for i in range(0, len(target), 1 << 13):
            here = slice(i, i + (1 << 13))
            own = self.r.take(target[here], axis=0)
            if several:
                own += self.groups.take(group[here], axis=0)
            q = self.q1.take(one[here], axis=0)
            q += self.q2.take(two[here], axis=0)
            out[here] = np.einsum("ij,ij->i", q, own[:, :-1]) + own[:, -1]
        if several:
            out -= self._log_sums(first, second, self.groups, at_once)[at]
        pair, of = _distinct(group * len(context) + at)
        del at
        cuts, sums = np.searchsorted(pair, np.arange(len(self.groups) + 1) * len(context)), np.empty(len(pair))
        for g in np.flatnonzero(np.diff(cuts)):
            here = slice(cuts[g], cuts[g + 1])
            mine = pair[here] - g * len(context)
            sums[here] = self._log_sums(first[mine], second[mine], self.r[g * self.per : (g + 1) * self.per], at_once)
        out -= sums[of]
        return out

    def _log_sums(self, first, second, rows: np.ndarray, at_once: int, least: int = 1000) -> np.ndarray:
        """For each context the log of the sum of its exponentiated scores over all rows; equal first units are neighbours.

        A score is a sum over the two places, so its exponential is a product of one factor a place. Where many
        contexts share few units, factors are made once a unit instead of exponentials for each context.
        """
        if len(first) >= least:
            (a, i), (b, j) = _distinct(first), _distinct(second)
            if 4 * (len(a) + len(b)) < 3 * len(first):
                found = _log_sums_of_products(self.q1[a], i, self.q2[b], j, rows)
                if found is not None:
                    return found
        found, dim = np.empty(len(first)), self.q1.shape[1]
        for at in range(0, len(first), 1 << 13):
            here = slice(at, at + (1 << 13))
            q = np.ones((len(first[here]), dim + 1), dtype=np.float32)  # the last column is for the bias
            np.add(self.q1[first[here]], self.q2[second[here]], out=q[:, :-1])
            found[here] = _log_sums(q, rows, at_once)
        return found


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (not negative) in order, and each key's place among them."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 62:
        return np.unique(keys, return_inverse=True)
    both = keys << bits  # keys and places as one number are sorted faster than places by keys
    both |= np.arange(len(keys))
    both.sort()
    place = (both & ((1 << bits) - 1)).astype(np.int32)
    both >>= bits
    new = np.concatenate(([True], both[1:] != both[:-1]))
    at = np.empty(len(keys), dtype=np.int32)
    at[place] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return both[new], at


def _log_sums_of_products(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, rows: np.ndarray, width: int = 32, at_once: int = 1024) -> np.ndarray | None:
    """Logs of sums over rows of exp(x[i] row) exp(y[j] row + bias), some rows at a time; None if factors may leave single precision."""
    sums = np.zeros(len(i), dtype=np.float32)
    for c in range(0, len(rows), width):
        part = rows[c : c + width]
        e, f = x @ part[:, :-1].T, y @ part[:, :-1].T
        f += part[:, -1]
        if max(float(e.max()), -float(e.min())) + max(float(f.max()), -float(f.min())) > 75:
            return None
        np.exp(e, out=e)
        np.exp(f, out=f)
        for at in range(0, len(i), at_once):
            here = slice(at, at + at_once)
            sums[here] += np.einsum("ij,ij->i", e.take(i[here], axis=0), f.take(j[here], axis=0))
    return np.log(sums, dtype=np.float64)


def _log_sums(q: np.ndarray, rows: np.ndarray, at_once: int) -> np.ndarray:
    """For each vector the log of the sum of its exponentiated inner products with all rows."""
    found, columns, ones = np.empty(len(q)), np.ascontiguousarray(rows.T), np.ones(len(rows), dtype=np.float32)
    # No score is larger than the product of the norms (Cauchy and Schwarz).
    small = (np.einsum("ij,ij->i", q, q).max() * np.einsum("ij,ij->i", rows, rows).max()) < 60.0**2
    for i in range(0, len(q), at_once):
        s, top = q[i : i + at_once] @ columns, 0.0
        if not small and (float(s.max()) > 60 or float(s.min()) < -60):  # beyond single precision's exponents
            top = s.max(axis=1)
            s -= top[:, None]
        np.exp(s, out=s)
        found[i : i + at_once] = top + np.log(s @ ones)
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _by_row(index: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, how often each occurs, and the sums of their gradients."""
    bits = len(index).bit_length()
    both = (index.astype(np.int64) << bits) | np.arange(len(index))
    both.sort()
    order, index = both & ((1 << bits) - 1), both >> bits
    begins = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    return index[begins], np.diff(np.append(begins, len(index))), np.add.reduceat(g.take(order, axis=0), begins, axis=0)


def held_out(id_col: str, folds: int = 5) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 1, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts (a column ``text`` of binary); the end token is END."""

    def run(batches):
        import pyarrow as pa

        for b, i in ((b, i) for b in batches for i in range(0, b.num_rows, 4000)):
            ws, sizes = split(b.column("text").slice(i, 4000))
            got = ws.value_counts()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([got.field("values"), pa.array([END])]), pa.concat_arrays([got.field("counts"), pa.array([len(sizes)])])], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


class Scorer:
    """All that a task needs: the model, and the counts of common words and of classes."""

    def __init__(self, units: Units, model: LogBilinear, head: dict[bytes, int], total: int, distinct: int, class_n: np.ndarray, class_v: np.ndarray):
        import pyarrow as pa

        self.units, self.model, self.total, self.distinct = units, model, total, distinct
        self.head = pa.array(list(head), type=pa.binary())
        self.log = np.log10(np.array([*head.values(), 0]) + 0.5)
        self.unit = np.append(units.numbers(self.head), np.int32(-1))
        self.known_end = END in head
        self.end = list(head).index(END) if self.known_end else -1
        #: log10 of what a word's count plus a half is divided by, among all words and in its class
        self.all = math.log10(total + 0.5 * (distinct + 1))
        self.within = np.log10(class_n + 0.5 * (class_v + 1))

    def score(self, texts) -> dict:
        """Sums of each text without the counts of words outside the head; those words and their numbers, and where each text's begin."""
        import pyarrow as pa

        u, (ws, sizes) = self.units, split(texts)
        at = places(ws, self.head)
        lost = np.flatnonzero(at < 0)  # among words; a text's end comes after them
        text = np.searchsorted(np.cumsum(sizes), lost, side="right")
        others, at, sizes = ws.take(pa.array(lost)), with_ends(at, sizes + 1, self.end), sizes + 1
        del ws
        ends = np.cumsum(sizes)
        begins = ends - sizes
        target, log = self.unit[at], np.where(at >= 0, self.log[at], 0.0)
        if not self.known_end:  # no training document at all
            target[ends - 1], log[ends - 1] = u.end, math.log10(0.5)
        target[lost + text] = u.numbers(others)
        named = others.dictionary_encode()
        pair, f = np.unique(text * (len(named.dictionary) + 1) + named.indices.to_numpy(), return_counts=True)
        text, word = np.divmod(pair, len(named.dictionary) + 1)
        one, two = u.context(target, sizes)
        kind = target - u.end - 1
        each = self.model.log_probability(target, one, two) / LOG10
        each += np.where(kind >= 0, log - self.within[np.maximum(kind, 0)], 0.0)
        return {
            "n_tokens": sizes, "n_known": np.add.reduceat((at >= 0).astype(np.int64), begins),
            "base": np.add.reduceat(log, begins) - self.all * sizes, "model": np.add.reduceat(each, begins),
            "tail": (named.dictionary.take(pa.array(word)), f, np.searchsorted(text, np.arange(len(sizes) + 1))),
        }


def fit(train: DataFrame, frequent: int = 1000, classes: int = 256, dim: int = 24, warm: int = 800, head: int = 1 << 17, least: int = 20) -> tuple[Scorer, DataFrame]:
    """A scorer from training texts (``key``, ``text`` as binary), and the table of all words' counts."""
    spark = train.sparkSession
    counts = materialize(word_counts(train), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(least, math.ceil(math.sqrt(total) / 100))
    own = counts.filter(F.col("n") >= least)  # as many as there are units
    top = most_frequent(counts, "n", head)
    if own.count() > top.count():
        top = own
    top = top.toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    common = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))
    if END not in common and total:
        common[END] = counts.filter(F.col("word") == END).first()["n"]
    units = Units([w for i, (w, n) in enumerate(common.items()) if w != END and (i < frequent or n >= least)], classes)
    send = spark.sparkContext.broadcast(units)

    def by_class(batches):
        import pyarrow as pa

        n, v, of = np.zeros(classes, dtype=np.int64), np.zeros(classes, dtype=np.int64), send.value
        for b in batches:
            k = of.numbers(b.column("word")) - of.end - 1
            c, k = b.column("n").to_numpy()[k >= 0], k[k >= 0]
            np.add.at(n, k, c)
            np.add.at(v, k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(classes)), pa.array(n), pa.array(v)], ["k", "n", "v"])

    class_n, class_v = np.zeros(classes), np.zeros(classes)
    for r in counts.mapInArrow(by_class, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    unit_n = np.concatenate(([common[w] for w in list(units)[: units.end]], [common.get(END, 0)], class_n))
    model = LogBilinear.fresh(unit_n, dim)
    if total:
        noise = (unit_n + 0.5) / (unit_n + 0.5).sum()
        sample = [r["text"] for r in smallest(train, F.xxhash64("text"), warm).select("text").collect()]
        target, sizes = units.sequence(sample)
        state = None
        for e in range(3):
            state = model.train(target, *units.context(target, sizes), noise, seed=e, state=state)
        model = _train_on_all(train, units, model, state, noise)
    return Scorer(units, model, common, int(total), int(distinct), class_n, class_v), counts


def _train_on_all(train: DataFrame, units: Units, model: LogBilinear, state, noise: np.ndarray) -> LogBilinear:
    """One pass over all training texts in parallel, and the average of the tasks' parameters by their tokens."""
    context = train.sparkSession.sparkContext
    send = context.broadcast((units, model, state, noise))
    dim = model.q1.shape[1]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        units, start, state, noise = send.value
        own = LogBilinear(*(x.copy() for x in start.tables()))
        state, used = [s.copy() for s in state], [np.zeros(len(x), dtype=np.int64) for x in own.tables()]
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                target, sizes = units.sequence(b.column("text").slice(i, 1000))
                own.train(target, *units.context(target, sizes), noise, seed=TaskContext.get().partitionId() + i, state=state, used=used)
        first = 0
        for x, n in zip(own.tables(), used, strict=True):
            rows = np.flatnonzero(n)
            v = np.pad(x[rows], ((0, 0), (0, dim + 1 - x.shape[1]))) * n[rows, None].astype(np.float32)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(first + rows), pa.array(n[rows]), *map(pa.array, v.T.copy())], ["row", "uses", *(f"v{j}" for j in range(dim + 1))])
            first += len(x)

    schema = "row long, uses long, " + ", ".join(f"v{j} float" for j in range(dim + 1))
    done = train.select("text").coalesce(max(1, context.defaultParallelism)).mapInArrow(run, schema)
    uses = F.sum("uses")
    means = done.groupBy("row").agg(*((F.sum(f"v{j}") / uses).cast("float").alias(f"v{j}") for j in range(dim + 1))).toArrow()  # a row for each vector
    row, v = means.column("row").to_numpy(), np.stack([means.column(f"v{j}").to_numpy() for j in range(dim + 1)], axis=1)
    first, out = 0, []
    for x in model.tables():
        x, here = x.copy(), (row >= first) & (row < first + len(x))
        x[row[here] - first] = v[here, : x.shape[1]]
        out.append(x)
        first += len(x)
    return LogBilinear(*out)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    src = docs.select(F.col(id_col).alias("id_"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    scorer, counts = fit(src.filter(~F.col("held_out")).select("text"), **options)
    send = src.sparkSession.sparkContext.broadcast(scorer)
    kind = src.schema["id_"].dataType

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 40
        for b in batches:
            of = send.value
            for part in slices(b, "text", 4000, 6 << 20):
                got, n = of.score(part.column("text")), part.num_rows
                cols = [pa.array(range(key, key + n), type=pa.int64()), part.column("id_"), part.column("held_out")]
                cols += [pa.array(got["n_tokens"]), pa.array(got["n_known"]), pa.array(got["base"]), pa.array(got["model"])]
                word, f, cuts = got["tail"]
                pairs = pa.StructArray.from_arrays([word, pa.array(f, type=pa.int64())], ["word", "f"])
                key += n
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), pairs)], ["key", "id_", "held_out", "n_tokens", "n_known", "base", "model", "tail"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id_", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType())])
    tail_kind = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("f", T.LongType())])
    partial = materialize(src.mapInArrow(run, T.StructType([*schema.fields, T.StructField("tail", T.ArrayType(tail_kind))])), "partial-scores")
    tail = partial.select("key", F.explode("tail").alias("t")).select("key", "t.word", "t.f")
    n = F.coalesce("n", F.lit(0))
    sums = tail.join(counts, "word", "left").groupBy("key").agg(F.sum(F.col("f") * F.log10(n + 0.5)).alias("tail_log"), F.sum(F.when(n > 0, F.col("f")).otherwise(0)).alias("tail_known"))
    out = partial.drop("tail").join(sums, "key", "left")
    log = F.coalesce("tail_log", F.lit(0.0))
    return out.select(
        F.col("id_").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(scorer.total).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("model") + log).alias("score"),
    )

"""Co-trained quality classifiers: what a text says, and what its page looks like.

For each target (quality, toxic) two logistic classifiers see disjoint views: the words of
the text, and metadata (language, source, size and shape of the page). Both are fitted on
a bounded sample of labelled documents. In rounds, each names the unlabelled documents it is
sure of, among all there are, and these join the other's training rows: they are scored where
they lie, and only sums of gradients and curvatures come to the driver. Last, a small logistic model fitted on
labelled rows that were held back turns both scores into one calibrated probability.
"""

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsewatch.llm.common import read, received, shipped, stored

LABELLED = 8_000
ROUNDS = 3
CONFIDENT = 0.98
WORDS = 500
LEAST_DOCS = 5
STEM = 5
HELD_BACK = 4
TARGETS = ("quality", "toxic")
PENALTY = {"text": 2.0, "meta": 0.5}
STEPS = 25
STRIP = 32_768

LETTERS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).lower()


def words(text):
    """Sorted hashes of the distinct words of a UTF-8 text and of the longer ones' beginnings.

    Words are runs of letters, digits and characters beyond ASCII, A-Z as a-z.
    """
    found = set(text.translate(LETTERS).split())
    found |= {b"^" + w[:STEM] for w in found if len(w) > STEM}
    return np.unique(np.fromiter(map(zlib.crc32, found), np.int64, len(found)))


def outline(text):
    """Size and make-up of one text."""
    n = len(text)
    tokens = text.split()
    raw = np.frombuffer(text, np.uint8)
    ratio = np.bincount(KIND[raw], minlength=6)[:6] / max(1, n)
    sizes = len(tokens)
    return [np.log1p(n) / 10, np.log1p(sizes) / 10, *ratio, len(set(tokens)) / max(1, sizes), (n - sizes) / max(1, sizes) / 10]


def seen_values(rows, least_docs=LEAST_DOCS):
    """(languages, sources) that at least `least_docs` labelled rows have, null counting as empty."""
    return tuple(
        tuple(sorted(v for v, n in Counter(r[c] or "" for r in rows).items() if n >= least_docs)) for c in ("_l", "_s")
    )


def marks(lang, source, seen):
    """A mark for each language and source seen in training, and one each for all others."""
    out = []
    for value, known in zip((lang, source), seen):
        own = [0.0] * (len(known) + 1)
        value = value or ""
        own[known.index(value) if value in known else len(known)] = 1.0
        out += own
    return out


def shape(text, lang, source, seen=((), ())):
    """Metadata features of one document."""
    return outline(text) + marks(lang, source, seen)


def kind_of(c):
    if c >= 128 or chr(c).isalpha():
        return 0
    if chr(c).isdigit():
        return 1
    if c in (10, 13):
        return 2
    if c in (9, 32):
        return 3
    return 4 if chr(c) in ".,;:!?'\"()-" else 5


KIND = np.array([kind_of(c) for c in range(256)], np.uint8)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x, y, weight=None, penalty=1.0, steps=25, chunk=1_000):
    """Logistic regression with an intercept (last weight), by Newton steps.

    Rows are worked on in chunks, so that only a chunk is ever held as doubles.
    """
    n, d = x.shape
    w = np.zeros(d + 1)
    weight = np.ones(n) if weight is None else weight
    ridge = np.full(d + 1, penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        gradient, curve = ridge * w, np.diag(ridge)
        for low in range(0, n, chunk):
            part = np.hstack([x[low : low + chunk].astype(np.float64), np.ones((min(chunk, n - low), 1))])
            p = sigmoid(part @ w)
            own = weight[low : low + chunk]
            gradient += part.T @ (own * (p - y[low : low + chunk]))
            curve += (part * (own * p * (1 - p))[:, None]).T @ part
        move = np.linalg.solve(curve, gradient)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class Target:
    """One target's text view, metadata view and their combination."""

    vocabulary: np.ndarray = None
    text: np.ndarray = None
    meta: np.ndarray = None
    centre: np.ndarray = None
    spread: np.ndarray = None
    joint: np.ndarray = None
    seen: tuple = ((), ())

    def text_scores(self, bags):
        out = np.full(len(bags), self.text[-1])
        for i, bag in enumerate(bags):
            out[i] += self.text[places(bag, self.vocabulary)].sum()
        return out

    def meta_scores(self, shapes):
        return ((shapes - self.centre) / self.spread) @ self.meta[:-1] + self.meta[-1]

    def probability(self, bags, shapes):
        if self.joint is None:
            return np.full(len(bags), np.nan)
        both = np.stack([self.text_scores(bags), self.meta_scores(shapes)], 1)
        return sigmoid(np.clip(both, -20, 20) @ self.joint[:2] + self.joint[2])


def places(bag, vocabulary):
    """Where the sorted vocabulary has the words of a bag."""
    if not len(vocabulary) or not len(bag):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, bag), len(vocabulary) - 1)
    return at[vocabulary[at] == bag]


def choose_words(bags, y, most, least_docs):
    """The words that tell the classes apart best (chi-squared), in at least `least_docs` texts."""
    if not any(map(len, bags)):
        return np.zeros(0, np.int64)
    names, c = np.unique(np.concatenate(bags), return_counts=True)
    c, a = c.astype(float), np.zeros(len(names))
    # Words of the one class are among those of both.
    own, n = np.unique(np.concatenate([b[:0] if told == 0 else b for b, told in zip(bags, y)]), return_counts=True)
    a[np.searchsorted(names, own)] = n
    names = names.astype(np.int64)
    share = float(np.mean(y))
    expected = c * share
    gap = (a - expected) ** 2 / (expected * (1 - share))
    gap[c < least_docs] = -1
    order = np.lexsort((names, -gap))[:most]
    return np.sort(names[order[gap[order] >= 0]])


def matrix(bags, vocabulary):
    x = np.zeros((len(bags), len(vocabulary)), np.uint8)
    for i, bag in enumerate(bags):
        x[i, places(bag, vocabulary)] = 1
    return x


@dataclass
class Ask:
    """What a learner wants summed over unlabelled rows: earlier rounds' weights, and those to judge."""

    model: Target
    past: list
    weights: dict
    confident: float


def lent_labels(x, past, confident):
    """{view: labels} that the other view has lent it, of the latest round that was sure; NaN without one."""
    out = {view: np.full(len(x[view]), np.nan) for view in x}
    for weights in past:
        for view, other in (("text", "meta"), ("meta", "text")):
            p = sigmoid(x[view] @ weights[view][:-1] + weights[view][-1])
            sure = (p >= confident) | (p <= 1 - confident)
            out[other][sure] = p[sure] >= 0.5
    return out


def sums(x, y, w, chunk=1_000):
    """Rows, loss, gradient and curvature of a logistic regression at `w`, in one flat array."""
    d = len(w)
    out = np.zeros(2 + d + d * d)
    for low in range(0, len(x), chunk):
        part = np.hstack([x[low : low + chunk].astype(np.float64), np.ones((min(chunk, len(x) - low), 1))])
        own, z = y[low : low + chunk], part @ w
        p = sigmoid(z)
        out[0] += len(own)
        out[1] += (np.logaddexp(0, z) - own * z).sum()
        out[2 : 2 + d] += part.T @ (p - own)
        out[2 + d :] += ((part * (p * (1 - p))[:, None]).T @ part).ravel()
    return out


def lent_sums(ask, places_of, shapes, chunk=1_000):
    """{view: sums} over the rows among these that the other view has lent."""
    out = {view: np.zeros(2 + len(w) + len(w) ** 2) for view, w in ask.weights.items()}
    for low in range(0, len(shapes), chunk):
        own = places_of[low : low + chunk]
        text = np.zeros((len(own), len(ask.model.vocabulary)))
        for i, at in enumerate(own):
            text[i, at] = 1
        x = {"text": text, "meta": (shapes[low : low + chunk] - ask.model.centre) / ask.model.spread}
        labels = lent_labels(x, ask.past, ask.confident)
        for view, w in ask.weights.items():
            told = ~np.isnan(labels[view])
            if told.any():
                out[view] += sums(x[view][told], labels[view][told], w)
    return out


def refit(own, y, model, past, confident):
    """Weights of both views on labelled and lent rows, by Newton steps from the last round's.

    All lent rows together weigh at most as much as the labelled ones. A step that makes the
    loss worse is halved.
    """
    weights, last, todo = dict(past[-1]), {}, {"text", "meta"}
    for _ in range(STEPS):
        found = yield Ask(model, past, {view: weights[view] for view in sorted(todo)}, confident)
        for view in sorted(todo):
            w, lent = weights[view], found[view]
            d = len(w)
            ridge = np.full(d, PENALTY[view])
            ridge[-1] = 1e-3
            total = sums(own[view], y, w) + min(1.0, len(y) / max(1.0, lent[0])) * lent
            loss = total[1] + ridge @ (w * w) / 2
            if view in last and loss > last[view][0] + 1e-9 * abs(loss):
                weights[view] = (w + last[view][1]) / 2
                continue
            move = np.linalg.solve(total[2 + d :].reshape(d, d) + np.diag(ridge), total[2 : 2 + d] + ridge * w)
            last[view], weights[view] = (loss, w), w - move
            if np.abs(move).max() < 1e-6:
                todo.discard(view)
        if not todo:
            break
    return weights


def learn(bags, shapes, y, rounds=ROUNDS, confident=CONFIDENT, most_words=WORDS, least_docs=LEAST_DOCS, seen=((), ())):
    """A `Target` from labelled rows; without rows of both classes it knows nothing.

    A generator: it yields an `Ask` for each sum over the unlabelled rows, and is sent it.
    """
    model = Target(seen=seen)
    y = np.asarray(y, float)
    if len(y) < 2 * HELD_BACK or y.min() == y.max():
        return model
    # Every HELD_BACK-th row of each class calibrates.
    turn = np.zeros(len(y), int)
    for c in (0, 1):
        turn[y == c] = np.arange(int((y == c).sum()))
    held = turn % HELD_BACK == HELD_BACK - 1
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    train = np.flatnonzero(~held)
    model.vocabulary = choose_words([bags[i] for i in train], y[train], most_words, least_docs)
    model.centre, model.spread = shapes[train].mean(0), shapes[train].std(0) + 1e-6
    own = {"text": matrix([bags[i] for i in train], model.vocabulary), "meta": (shapes[train] - model.centre) / model.spread}
    past = [{view: fit(own[view], y[train], penalty=PENALTY[view]) for view in own}]
    for _ in range(rounds):
        past.append((yield from refit(own, y[train], model, list(past), confident)))
    model.text, model.meta = past[-1]["text"], past[-1]["meta"]
    judge = np.flatnonzero(held) if held.any() else train
    scores = np.stack([model.text_scores([bags[i] for i in judge]), model.meta_scores(shapes[judge])], 1)
    model.joint = fit(np.clip(scores, -20, 20), y[judge], penalty=0.01)
    return model


def co_train(bags, shapes, y, free_bags, free_shapes, **options):
    """`learn` with unlabelled rows in memory."""
    learner, answer = learn(bags, shapes, y, **options), None
    while True:
        try:
            ask = learner.send(answer)
        except StopIteration as done:
            return done.value
        answer = lent_sums(ask, [places(b, ask.model.vocabulary) for b in free_bags], free_shapes)


def placed(free, vocabularies, seen):
    """Unlabelled rows with, for each target, where its vocabulary has their words."""
    free = free.select("doc_id", "_t", "_l", "_s")
    names = ["doc_id", *vocabularies, "shape"]

    def run(batches):
        for batch in batches:
            texts, langs, sources = (batch.column(1 + i).to_pylist() for i in range(3))
            raw = [(t or "").encode() for t in texts]
            bags = [words(t) for t in raw]
            at = [pa.array([places(b, v).astype(np.int32) for b in bags], pa.list_(pa.int32())) for v in vocabularies.values()]
            shapes = pa.array([shape(t, a, s, seen) for t, a, s in zip(raw, langs, sources)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *at, shapes], names)

    kinds = ", ".join(f"{t} array<int>" for t in vocabularies)
    return free.mapInArrow(run, f"doc_id long, {kinds}, shape array<double>")


def summed(free, asks):
    """{target: {view: sums}} over all unlabelled rows.

    Each task adds up its rows; strips of the sums are added up over tasks, so that the driver
    gets one array a target and view, however many rows and tasks there are.
    """
    shared = shipped(free.sparkSession, asks)
    keys = [(t, view) for t, ask in asks.items() for view in ask.weights]

    def run(batches):
        own = received(shared)
        total = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            shapes = np.array(batch.column("shape").to_pylist(), float)
            for t, ask in own.items():
                at = batch.column(t)
                places_of = [x.values.to_numpy() for x in at]
                for view, x in lent_sums(ask, places_of, shapes).items():
                    total[t, view] = total.get((t, view), 0) + x
        rows = [(keys.index(k), low, x[low : low + STRIP].tobytes()) for k, x in total.items() for low in range(0, len(x), STRIP)]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["key", "low", "part"])

    def add(table):
        part = sum(np.frombuffer(x) for x in table.column("part").to_pylist())
        return pa.table({"key": table.column("key")[:1], "low": table.column("low")[:1], "part": pa.array([part.tobytes()], pa.binary())})

    strips = free.select(*asks, "shape").mapInArrow(run, "key long, low long, part binary")
    found = strips.groupBy("key", "low").applyInArrow(add, "key long, low long, part binary").toArrow()
    out = {t: {view: np.zeros(2 + len(w) + len(w) ** 2) for view, w in ask.weights.items()} for t, ask in asks.items()}
    for key, low, strip in zip(found.column("key").to_pylist(), found.column("low").to_pylist(), found.column("part")):
        t, view = keys[key]
        part = np.frombuffer(strip.as_buffer())
        out[t][view][low : low + len(part)] = part
    shared.destroy()
    return out


def features(rows, extra):
    """Words and outlines of rows (`extra`, _t, _l, _s), next to `extra`, languages and sources.

    Hashes of words travel as the 32 bits they have.
    """

    def run(batches):
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(len(extra)).to_pylist()]
            bags = pa.array([words(t).astype(np.uint32).view(np.int32) for t in raw], pa.list_(pa.int32()))
            shapes = pa.array([outline(t) for t in raw], pa.list_(pa.float64()))
            told = batch.columns[: len(extra)] + batch.columns[len(extra) + 1 :]
            yield pa.RecordBatch.from_arrays([*told, bags, shapes], [*extra, "_l", "_s", "bag", "shape"])

    kinds = ", ".join(f"{c} long" for c in extra)
    return rows.select(*extra, "_t", "_l", "_s").mapInArrow(run, f"{kinds}, _l string, _s string, bag array<int>, shape array<double>")


def arrays(table, extra):
    """Rows with their bags as arrays, in an order that depends on them alone."""
    table = table.combine_chunks()
    columns = {c: table.column(c).to_pylist() for c in [*extra, "_l", "_s", "shape"]}
    rows = []
    for i in range(table.num_rows):
        bag = table.column("bag")[i].values.to_numpy().view(np.uint32)
        rows.append({**{c: columns[c][i] for c in columns}, "bag": bag})
    return sorted(rows, key=lambda r: r["doc_id"])


def columns_of(docs, text_col, lang_col, source_col):
    have = set(docs.columns)
    none = F.lit(None).cast("string")
    return [F.col(text_col).alias("_t")] + [
        (F.col(c).cast("string") if c in have else none).alias(a) for c, a in ((lang_col, "_l"), (source_col, "_s"))
    ]


def first_by_hash(ids, n):
    """A fixed sample of at most n distinct ids, small enough to broadcast."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def train(docs, labels, labelled=LABELLED, rounds=ROUNDS, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", **options):
    """{target: model} from documents and labels (doc_id, quality, toxic).

    At most `labelled` labelled documents, chosen by the hash of their id and one row an id (the
    least hash), come to the driver as features. All others with an id can lend labels; of them
    only sums come, one scan of their stored features for each Newton step of a round (at most
    75 scans). Where an id has several labels, the least quality and the most toxic one count; null
    labels do not.
    """
    told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    told = told.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), *columns_of(docs, text_col, lang_col, source_col))
    named = named.where("doc_id is not null")
    with_text = told.join(named.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = F.broadcast(first_by_hash(with_text, labelled))
    # One row an id, put together where the rows are.
    texts = F.struct(F.xxhash64("_t", "_l", "_s").alias("h"), "_t", "_l", "_s")
    single = named.join(sample, "doc_id").groupBy("doc_id", *TARGETS).agg(F.min(texts).alias("d"))
    some = features(single.select("doc_id", *TARGETS, "d._t", "d._l", "d._s"), ["doc_id", *TARGETS])
    rows = arrays(some.toArrow(), ["doc_id", *TARGETS])
    seen = seen_values(rows)
    width = len(shape(b"", None, None, seen))

    def view(own):
        shapes = [r["shape"] + marks(r["_l"], r["_s"], seen) for r in own]
        return [r["bag"] for r in own], np.array(shapes, float).reshape(len(own), width)

    learners, asks, out = {}, {}, {}

    def go_on(target, answer):
        try:
            asks[target] = learners[target].send(answer)
        except StopIteration as done:
            asks.pop(target, None)
            out[target] = done.value

    for target in TARGETS:
        own = [r for r in rows if r[target] is not None]
        bags, shapes = view(own)
        learners[target] = learn(bags, shapes, [float(r[target] > 0) for r in own], rounds=rounds, seen=seen, **options)
        go_on(target, None)
    if asks:
        places_of = placed(named, {t: ask.model.vocabulary for t, ask in asks.items()}, seen)
        free = stored(places_of.join(told.select("doc_id"), "doc_id", "left_anti"), "unlabelled")
        while asks:
            answers = summed(free, dict(asks))
            for target, answer in answers.items():
                go_on(target, answer)
    # The driver does not keep what it has learned from.
    del rows, own, bags, shapes
    learners.clear()
    pa.default_memory_pool().release_unused()
    return out


def scored(docs, models, text_col="text", lang_col="lang", source_col="source", extra=()):
    """`extra` columns of `docs`, p_quality, p_toxic and kept, for every row."""
    extra = list(extra)
    rows = docs.select(*extra, *columns_of(docs, text_col, lang_col, source_col))
    shared = shipped(docs.sparkSession, models)

    def run(batches):
        own = received(shared)
        seen = own[TARGETS[0]].seen
        for batch in batches:
            texts, langs, sources = (batch.column(len(extra) + i).to_pylist() for i in range(3))
            raw = [(t or "").encode() for t in texts]
            bags = [words(t) for t in raw]
            shapes = np.array([shape(t, a, s, seen) for t, a, s in zip(raw, langs, sources)], float).reshape(len(raw), -1)
            p = [own[t].probability(bags, shapes) for t in TARGETS]
            shown = [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in p]
            kept = ~((p[0] < 0.5) | (p[1] >= 0.5))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(extra)], *shown, pa.array(kept)], [*extra, "p_quality", "p_toxic", "kept"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(extra)]]
    return rows.mapInArrow(run, ", ".join([*fields, "p_quality double", "p_toxic double", "kept boolean"]))


def classify(docs, labels, id_col="doc_id", text_col="text", **options):
    """doc_id, p_quality, p_toxic and kept of every row of `docs`.

    A document is rejected (not kept) if it is probably of no quality or probably toxic.
    Without labels of both kinds a probability is null and rejects nothing. Null and empty
    texts are judged by their metadata; missing lang or source columns count as null. Null
    ids are scored but never trained on; equal rows get equal scores; further columns are
    ignored; an empty table gives an empty result. Parameters: see `train`.
    """
    models = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    named = docs.withColumn("doc_id", F.col(id_col).cast("long")) if id_col != "doc_id" else docs
    return scored(named, models, text_col=text_col, extra=["doc_id"])


def reject(docs, labels, **options):
    """The rows of `docs`, all columns, that `classify` keeps."""
    models = train(docs, labels, **options)
    shared = shipped(docs.sparkSession, models)
    at = {c: i for i, c in enumerate(docs.columns)}

    def run(batches):
        own = received(shared)
        seen = own[TARGETS[0]].seen
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(at["text"]).to_pylist()]
            langs, sources = ([None] * len(raw) if c not in at else batch.column(at[c]).to_pylist() for c in ("lang", "source"))
            bags = [words(t) for t in raw]
            shapes = np.array([shape(t, a, s, seen) for t, a, s in zip(raw, langs, sources)], float).reshape(len(raw), -1)
            p = [own[t].probability(bags, shapes) for t in TARGETS]
            yield batch.filter(pa.array(~((p[0] < 0.5) | (p[1] >= 0.5))))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_classifier(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

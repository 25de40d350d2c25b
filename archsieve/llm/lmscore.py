"""LM scoring by cross-entropy difference.

Two n-gram models of order ``ORDER``, one of target documents and one of all documents, share one vocabulary:
the 256 byte values, with a space after each word and spaces before the first. A text's loss is the sum over its
tokens (bytes and ends of words). With ``across`` a context runs on over the words before, so the order of words counts, and
each distinct text of a block is scored once. Without it a context starts at its word, each distinct word of a
block is scored once and a document adds up the losses of its words. The score is the difference of the losses a token, target minus background: the
lower, the more a text is like the target.

Models are tables: counts of all n-grams of all documents, smoothed from order to order,
p(b | c) = (count(cb) + PRIOR * p(b | shorter c)) / (count(c) + PRIOR). The models are matched: the background's counts are
scaled to the target's mass, so that smoothing weighs alike in both. Nothing is sampled, and nothing is broadcast. Documents are dealt into blocks of about ``BLOCK_BYTES``; only the distinct n-grams of a block move to
the counts and back as probabilities, so one n-gram that is everywhere costs a row a block.

Null and empty texts have no tokens: losses 0, score null. Without target documents the target model is
uniform. Repeated rows give repeated results. Rows without an id are scored and never target.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archsieve.llm.common import stored

ORDER, PRIOR, SYMBOLS = 5, 5.0, 256
BLOCK_BYTES = 16 << 20
#: Words or texts whose n-grams are laid out at a time, and their bytes.
PART, PART_BYTES = 50_000, 1 << 19
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def units_of(text: str | None, across: bool) -> list[bytes]:
    """What is scored on its own: the words, or the running text."""
    words = words_of(text)
    return [b" ".join(words)] if across and words else words


def parts_of(units: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for u in units:
        part.append(u)
        size += len(u)
        if len(part) == PART or size >= PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, code): the n-grams of each word, a code holding the token in its lowest byte and its context above."""
    start = b" " * (ORDER - 1)
    sizes = np.array([len(w) + ORDER for w in words])
    raw = np.frombuffer(b"".join(start + w + b" " for w in words), dtype=np.uint8).astype(np.int64)
    code = np.zeros(len(raw), dtype=np.int64)
    for back in range(ORDER):
        code[back:] |= raw[: len(raw) - back] << (8 * back)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    use = place >= ORDER - 1
    return owner[use], code[use]


def blocks(docs: DataFrame, target: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(block, doc_id, text, wanted): the documents dealt into blocks of about BLOCK_BYTES. A row's place decides its block, so neither an id nor a
    text that many rows have fills one; the table is stored, so that every step sees the same blocks."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    flags = target.select(F.col("doc_id").alias("_wanted")).where("_wanted is not null").distinct()
    rows = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).alias("block"), docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return stored(rows.join(flags, F.col("doc_id") == F.col("_wanted"), "left").select("block", "doc_id", "text", F.col("_wanted").isNotNull().alias("wanted")), "lm-blocks")


def gram_counts(dealt: DataFrame, across: bool = False) -> DataFrame:
    """(block, gram, target, background): how often each block's n-grams occur."""

    def count(docs: pa.Table) -> pa.Table:
        every: Counter[bytes] = Counter()
        some: Counter[bytes] = Counter()
        for batch in docs.to_batches(max_chunksize=256):
            for t, wanted in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = units_of(t, across)
                every.update(words)
                if wanted:
                    some.update(words)
        block = docs["block"][0].as_py()
        parts = []
        for part in parts_of(list(every)):
            owner, code = grams(part)
            found, at = np.unique(code, return_inverse=True)
            weights = (np.array([c.get(w, 0) for w in part], dtype=np.float64)[owner] for c in (some, every))
            parts.append((found, *(np.bincount(at, w, minlength=len(found)).astype(np.int64) for w in weights)))
        found, *sums = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        found, at = np.unique(found, return_inverse=True)
        return pa.table({"block": pa.array(np.full(len(found), block)), "gram": pa.array(found), **{k: pa.array(np.bincount(at, x, minlength=len(found)).astype(np.int64)) for k, x in zip(("target", "background"), sums)}})

    return dealt.groupBy("block").applyInArrow(count, "block long, gram long, target long, background long")


def model(counts: DataFrame) -> DataFrame:
    """(gram, target, background): natural log probabilities of each n-gram's last token. counts: (gram, target, background)."""
    both = ("target", "background")
    total = lambda: [F.sum(k).alias(k) for k in both]
    whole = stored(counts.groupBy("gram").agg(*total()), "grams")
    # the background is all documents, its counts scaled to the target's mass: both models are smoothed alike, and no row is left out
    mass = whole.agg(*total()).first()
    scale = {"target": 1.0, "background": mass["target"] / mass["background"] if mass["target"] else 1.0}
    lower: DataFrame | None = None
    for order in range(1, ORDER + 1):
        here = whole if order == ORDER else whole.groupBy(F.col("gram").bitwiseAND((1 << 8 * order) - 1).alias("gram")).agg(*total())
        context = F.shiftright("gram", 8)
        after = here.groupBy(context.alias("context")).agg(*[F.sum(k).alias(f"{k}_context") for k in both])
        joined = here.withColumn("context", context).join(after, "context")
        if lower is None:
            shorter = {k: F.lit(1 / SYMBOLS) for k in both}
        else:
            joined = joined.withColumn("short", F.col("gram").bitwiseAND((1 << 8 * (order - 1)) - 1)).join(lower, "short")
            shorter = {k: F.col(f"{k}_shorter") for k in both}
        p = {k: (F.lit(scale[k]) * F.col(k) + PRIOR * shorter[k]) / (F.lit(scale[k]) * F.col(f"{k}_context") + PRIOR) for k in both}
        if order == ORDER:
            return joined.select("gram", *[F.log(p[k]).alias(k) for k in both])
        lower = joined.select(F.col("gram").alias("short"), *[p[k].alias(f"{k}_shorter") for k in both])
    raise AssertionError


def score(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", across: bool = False) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) of every row. target: the ids of the target documents; across: contexts
    run over the words of a text."""
    dealt = blocks(docs, target, doc_id, text)
    counts = stored(gram_counts(dealt, across), "block-grams")
    back = counts.select("block", "gram").join(model(counts), "gram")
    kind = dealt.schema["doc_id"]

    def add(rows: pa.Table, known: pa.Table) -> pa.Table:
        code = known["gram"].to_numpy()
        order = np.argsort(code)
        code = code[order]
        chance = np.stack([known[k].to_numpy()[order] for k in ("target", "background")])
        losses: dict[bytes, int] = {}
        table = [np.zeros((3, 0))]
        out = []
        for batch in rows.to_batches(max_chunksize=256):
            bodies = [units_of(t, across) for t in batch.column(2).to_pylist()]
            for new in parts_of(list({w for ws in bodies for w in ws if w not in losses})):
                owner, at = grams(new)
                at = np.searchsorted(code, at)
                table.append(np.stack([np.bincount(owner, minlength=len(new)).astype(np.float64), *(-np.bincount(owner, c[at], minlength=len(new)) for c in chance)]))
                losses.update(zip(new, range(len(losses), len(losses) + len(new))))
            table = [np.concatenate(table, axis=1)]
            for ws in bodies:
                at = [losses[w] for w in ws]
                out.append(table[0][:, at].sum(axis=1) if at else np.zeros(3))
        sums = np.array(out).reshape(-1, 3)
        with np.errstate(invalid="ignore", divide="ignore"):
            difference = (sums[:, 1] - sums[:, 2]) / sums[:, 0]
        return pa.table({"doc_id": rows["doc_id"], "n_tokens": pa.array(sums[:, 0].astype(np.int64)), "loss_target": pa.array(sums[:, 1]), "loss_background": pa.array(sums[:, 2]), "score": pa.array(difference, mask=sums[:, 0] == 0)})

    schema = T.StructType([kind, T.StructField("n_tokens", T.LongType()), *(T.StructField(k, T.DoubleType()) for k in ("loss_target", "loss_background", "score"))])
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(add, schema)

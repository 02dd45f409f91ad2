"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Symbols are the bytes of UTF-8 text, so an n-gram of up to seven fits a 64-bit integer without collisions. For each
language, n-grams of texts labelled as good are counted in each task and summed by key; lower orders count the
different symbols before an n-gram; discounts D1, D2, D3+ come from counts of counts. Probabilities of all n-grams
that were seen, and the back-off weights of all contexts, come from joins of these count tables on n-gram keys, which
shuffle by key however large they grow.

Documents are scored by one sharded join, the same at every size. They are dealt, in compressed batches, to blocks of about BLOCK_BYTES; the
different n-grams of a block go, packed, to the shard that holds the two symbols before their last one, and so do the
rows of the model: all orders from three on of an n-gram and its contexts then lie in one shard. Orders one and two
have at most 66,000 rows a language and are sent to every task. What a shard finds goes back to the block, whose
documents are summed from it. Only distinct n-grams of blocks and, once, the compressed texts are moved.

One trusted document of FOLDS (by hashed id) is not counted. A document is kept if its log perplexity per byte is not
below a low quantile of that of all trusted documents of its language, which are no less likely than unseen ones, and not
above a high quantile of that of the uncounted ones; each limit is moved outwards by a margin that is wider for short
texts.

Defined cases: a null or empty text has no perplexity and is rejected; a language without trusted text, null included,
can't be judged: its documents are kept, without a perplexity; a language whose trusted documents are all counted takes
both limits from them, and one whose trusted documents are all left out counts as one without; repeated rows give repeated results; labels that repeat a document count once; an empty table
gives an empty result; without labels everything but empty texts is kept. Only doc_id, lang and text are looked at;
names that end in two underscores are taken.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kinloom.llm import text as tx
from kinloom.llm.store import rows_of, staged

ORDER = 5
#: Bytes of text in a block, whose different n-grams are looked up together.
BLOCK_BYTES = 32 << 20
#: Partitions that blocks are dealt to at most; a partition may hold many.
MOST_PARTS = 1 << 15
#: One trusted document of so many is left out of the counts, to see what unseen good text is like.
FOLDS = 5
LOW, HIGH = 0.01, 0.97
MARGIN = 0.05
#: Further margin, divided by the square root of the number of bytes: short texts vary more.
SLACK = 2.0
#: Digits of the log perplexity that the quantiles see, so that their state is bounded.
DIGITS = 3


def grams(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, as an integer, and the text it is of. Texts begin after line feeds."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(raw)) - np.repeat(at[:-1], n)
    out = np.zeros(len(raw), np.int64)
    for k in range(order - 1, -1, -1):
        back = np.full(len(raw), 10, np.int64)
        back[k:] = raw[: len(raw) - k] if k else raw
        out = out << 8 | np.where(place >= k, back, 10)
    return out, owner


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def _per_language(batch: pa.RecordBatch, order: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Language, rows, n-grams and their owners (as positions in rows) for each language in a slice."""
    langs = np.array(batch.column(1).to_pylist(), object)
    for lang in sorted({x for x in langs if x is not None}):
        rows = np.flatnonzero(langs == lang)
        raw, at = tx.as_bytes(batch.column(2).take(pa.array(rows)))
        g, owner = grams(raw, at, order)
        yield lang, rows, g, owner


def count(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n: counts of n-grams of the highest order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def rows(lang: str) -> pa.RecordBatch:
            g, n = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for part in tx.slices(batch):
                for lang, _, g, _ in _per_language(part, order):
                    g, n = np.unique(g, return_counts=True)
                    if lang in held:
                        g, inverse = np.unique(np.concatenate([held[lang][0], g]), return_inverse=True)
                        n = np.bincount(inverse, np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = [g, n]
                    if len(g) > 1_000_000:
                        yield rows(lang)
        for lang in list(held):
            yield rows(lang)

    return trusted.mapInArrow(of, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def model(trusted: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(lang, k, gram, logp) of every n-gram seen, and (lang, k, context, logb) of every context, for orders k."""
    counts = {order: staged(count(trusted, order), "grams")}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        counts[k] = staged(counts[k + 1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n")), "grams")
    seen, contexts, lower = [], [], None
    for k in range(1, order + 1):
        c = counts[k]
        of = c.groupBy("lang").agg(*[F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)])
        y = F.coalesce(F.try_divide("t1", F.col("t1") + 2 * F.col("t2")), F.lit(0.5))

        def discount(i: int, y: Column = y) -> Column:
            d = F.lit(float(i)) - F.try_divide((i + 1) * y * F.col(f"t{i + 1}"), F.col(f"t{i}"))
            return F.when((d > 0) & (d < i), d).otherwise(F.lit(0.5 * i))

        of = of.select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = c.join(F.broadcast(of), "lang").select("lang", "gram", F.shiftright("gram", 8).alias("context"), F.col("n").cast("double").alias("n"), d.alias("d"))
        context = c.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
        p = (F.col("n") - F.col("d")) / F.col("total")
        c = c.join(context, ["lang", "context"])
        if lower is None:
            c = c.select("lang", "gram", (p + F.col("taken") / F.col("total") / 256).alias("p"))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            c = c.withColumn("suffix", suffix).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])
            c = c.select("lang", "gram", (p + F.col("taken") / F.col("total") * F.col("q")).alias("p"))
        lower = staged(c, "probabilities")
        seen.append(lower.select("lang", F.lit(k).alias("k"), "gram", F.ln("p").alias("logp")))
        contexts.append(context.select("lang", F.lit(k).alias("k"), "context", F.ln(F.col("taken") / F.col("total")).alias("logb")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:]))
    return staged(union(seen), "seen"), staged(union(contexts), "contexts")


def _log_probabilities(tables: dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray]], lang: str, g: np.ndarray, order: int) -> np.ndarray:
    """Of different n-grams, by back-off."""
    out = np.zeros(len(g))
    left = np.arange(len(g))
    for k in range(order, 0, -1):
        now = g[left] & ((1 << 8 * k) - 1)
        keys, values = tables.get((lang, 0, k), (np.zeros(0, np.int64), np.zeros(0)))
        at = np.minimum(np.searchsorted(keys, now), max(0, len(keys) - 1))
        hit = keys[at] == now if len(keys) else np.zeros(len(now), bool)
        out[left[hit]] += values[at[hit]]
        left, now = left[~hit], now[~hit]
        keys, values = tables.get((lang, 1, k), (np.zeros(0, np.int64), np.zeros(0)))
        if len(keys) and len(left):
            at = np.minimum(np.searchsorted(keys, now >> 8), len(keys) - 1)
            hit = keys[at] == now >> 8
            out[left[hit]] += values[at[hit]]
    out[left] -= np.log(256)
    return out


def _pack(grams: np.ndarray) -> bytes:
    """Sorted integers as deflated differences, byte planes apart."""
    return zlib.compress(np.diff(grams, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<i8").reshape(-1))


def _shard_of(grams: np.ndarray, lang: int, shards: int) -> np.ndarray:
    return ((grams >> 8 & 0xFFFF) * 40503 + lang) % shards


def _packed(blocks: int):
    """Batches of rows, compressed, and the block of each, which follows from task and number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            block = (part * 7919 + k) % blocks  # in turn, from another block on in each task
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block__", "data"])

    return of


def _unpacked(data: pa.Scalar) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(data.as_buffer())


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """Slices of a batch, and of each the columns that are scored."""
    for part in tx.slices(batch, "text__"):
        columns = [part.column(part.schema.get_field_index(c)) for c in ("text__", "lang__")]
        yield part, pa.RecordBatch.from_arrays([pa.nulls(part.num_rows), columns[1], columns[0]], ["none", "lang", "text"])


def _lists(languages: dict[str, int], order: int, shards: int):
    """Of packed documents: the different n-grams of each block, language and shard."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[np.ndarray]] = {}

        def add(key: tuple[int, str], grams: np.ndarray) -> None:
            own = held.setdefault(key, [])
            own.append(np.unique(grams))
            if len(own) > 1 and sum(map(len, own)) > 1_000_000 + 2 * len(own[0]):
                held[key] = [np.unique(np.concatenate(own))]

        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for rows in _unpacked(data):
                    for _, part in _texts(rows):
                        for lang, _, g, _ in _per_language(part, order):
                            if lang in languages and len(g):
                                add((b, lang), g)
        for (b, lang), own in held.items():
            g = np.unique(np.concatenate(own))
            shard = _shard_of(g, languages[lang], shards)
            by = np.argsort(shard, kind="stable")
            g, shard = g[by], shard[by]
            cut = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(g))
            data = [_pack(g[i:j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            n = len(data)
            yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]], pa.int32()), pa.array([b] * n, pa.int32()), pa.array([lang] * n, pa.string()), pa.array(data, pa.binary())], ["shard", "block", "lang", "data"])

    return of


def _looked_up(common: dict, order: int):
    """In each shard: log probabilities of the blocks' n-grams. A shard's model rows come first, sorted by key."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tables = None, [], None
        for batch in batches:
            shard, kind = (batch.column(k).to_numpy() for k in (0, 1))
            cut = np.append(np.flatnonzero(np.diff(shard.astype(np.int64) * 4 + kind, prepend=-1)), batch.num_rows)
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if shard[i] != now:
                    now, parts, tables = shard[i], [], None
                rows = batch.slice(i, j - i)
                if kind[i] < 2:
                    parts.append(rows)
                    continue
                if tables is None:
                    tables = common | _tables(parts)
                    parts = []
                block, lang, grams, logp = rows.column(6), rows.column(2), rows.column(7), []
                for name, data in zip(lang.to_pylist(), grams.to_pylist(), strict=True):
                    value = _log_probabilities(tables, name, _unpack(data), order).astype("<f4")
                    logp.append(zlib.compress(value.view(np.uint8).reshape(-1, 4).T.tobytes(), 1))
                yield pa.RecordBatch.from_arrays([block, lang, grams, pa.array(logp, pa.binary())], ["block__", "lang", "grams", "logp"])

    return of


def _tables(parts: list[pa.RecordBatch]) -> dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray]]:
    """(language, kind, order) -> sorted keys and their values."""
    if not parts:
        return {}
    rows = pa.Table.from_batches(parts).combine_chunks()
    kind, k, key, value = (rows.column(c).to_numpy() for c in (1, 3, 4, 5))
    lang = rows.column(2).to_numpy(zero_copy_only=False)
    out = {}
    for name in dict.fromkeys(lang.tolist()):
        for c in (0, 1):
            for o in np.unique(k[(lang == name) & (kind == c)]).tolist():
                own = np.flatnonzero((lang == name) & (kind == c) & (k == o))
                own = own[np.argsort(key[own], kind="stable")]
                out[name, c, o] = key[own], value[own]
    return out


def _summed(order: int, names: list[str], schema: pa.Schema):
    """Of a block's documents and what the shards found: the named columns, n_bytes__, log_perplexity__."""

    def of(docs: pa.Table, found: pa.Table) -> pa.Table:
        tables: dict[str, list] = {}
        for lang, grams, logp in zip(*(found.column(c).to_pylist() for c in ("lang", "grams", "logp")), strict=True):
            value = np.frombuffer(zlib.decompress(logp), np.uint8).reshape(4, -1).T.copy().view("<f4").reshape(-1)
            tables.setdefault(lang, []).append((_unpack(grams), value))
        known = {}
        for lang, own in tables.items():
            g, v = (np.concatenate(x) for x in zip(*own, strict=True))
            by = np.argsort(g)
            known[lang] = g[by], v[by].astype(float)
        out = []
        for data in docs.column("data"):
            for batch in _unpacked(data):
                for rows, part in _texts(batch):
                    size = np.diff(tx.as_bytes(part.column(2))[1])
                    value = np.full(part.num_rows, np.nan)
                    for lang, at, g, owner in _per_language(part, order):
                        if lang in known and len(g):
                            keys, logp = known[lang]
                            total = np.bincount(owner, logp[np.searchsorted(keys, g)], minlength=len(at))
                            some = size[at] > 0
                            value[at[some]] = -total[some] / size[at][some]
                    own = [rows.column(rows.schema.get_field_index("text__" if c == "text" and "text" not in rows.schema.names else c)) for c in names]
                    out.append(pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), pa.array(value, mask=np.isnan(value))], [*names, "n_bytes__", "log_perplexity__"]))
        return pa.Table.from_batches(out) if out else schema.empty_table()

    return of


def score(docs: DataFrame, seen: DataFrame, contexts: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep``, all if not named, n_bytes__ and log_perplexity__ (null where the language has no model or
    the text is empty)."""
    spark = docs.sparkSession
    names = docs.columns if keep is None else keep
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).collect()[0][0] or 0
    blocks = max(1, -(-total // block_bytes))
    languages = {r["lang"]: k for k, r in enumerate(seen.select("lang").distinct().orderBy("lang").collect())}
    shards = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    code = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair]) if languages else F.lit(None)

    fields = [f for f in docs.schema.fields if f.name in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_bytes__ long, log_perplexity__ double"
    rows = docs.select(*[c for c in names if c != "text"], F.col("lang").cast("string").alias("lang__"), F.col("text").cast("string").alias("text__"), *([F.col("text")] if "text" in names and dict(docs.dtypes)["text"] != "string" else []))
    if not languages:
        return docs.select(*names, F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_bytes__"), F.lit(None).cast("double").alias("log_perplexity__"))
    rows = rows.mapInArrow(_packed(blocks), "block__ int, data binary").repartition(min(4 * blocks, MOST_PARTS), "block__")

    model = seen.select(F.lit(0).alias("kind"), "lang", "k", F.col("gram").alias("key"), F.col("logp").alias("value"))
    model = model.union(contexts.select(F.lit(1), "lang", "k", "context", "logb"))
    common = _tables([b for b in model.where("k <= 2").select(F.lit(0).alias("shard"), "kind", "lang", "k", "key", "value").toArrow().to_batches() if b.num_rows])
    pair = F.when(F.col("kind") == 0, F.shiftright("key", 8)).otherwise(F.col("key")).bitwiseAND(F.lit(0xFFFF))
    model = model.where("k > 2").select(F.pmod(pair * 40503 + F.element_at(code, F.col("lang")), F.lit(shards)).cast("int").alias("shard"), "kind", "lang", "k", "key", "value", F.lit(None).cast("int").alias("block"), F.lit(None).cast("binary").alias("data"))
    lists = rows.mapInArrow(_lists(languages, order, shards), "shard int, block int, lang string, data binary")
    lists = lists.select("shard", F.lit(2).alias("kind"), "lang", F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"), "block", "data")
    both = model.union(lists).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "lang", "k", "key")
    found = both.mapInArrow(_looked_up(common, order), "block__ int, lang string, grams binary, logp binary")
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return rows.groupBy("block__").cogroup(found.groupBy("block__")).applyInArrow(_summed(order, names, arrow), schema)


def _trusted_ids(labels: DataFrame) -> DataFrame:
    return staged(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted")


def _held_out() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0


def _counted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, lang, text of the trusted documents that are counted."""
    return rows_of(_source(docs).where("lang is not null"), staged(ids.where(~_held_out()), "counted"), "doc_id")


def _classified(docs: DataFrame, labels: DataFrame, order: int, low: float, high: float, margin: float, block_bytes: int, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep``, all if not named, then n_bytes__, log_perplexity__, low__, high__, keep__."""
    ids = _trusted_ids(labels)
    seen, contexts = model(_counted(docs, ids), order)
    scored = staged(score(docs, seen, contexts, order, block_bytes, keep), "scored")
    rounded = F.round("log_perplexity__", DIGITS)
    known = scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("of__"), "log_perplexity__").where("log_perplexity__ is not null")
    known = rows_of(known, ids, "doc_id")
    least = F.percentile(rounded, F.lit(low)) - margin
    most = F.coalesce(F.percentile(F.when(_held_out(), rounded), F.lit(high)), F.percentile(rounded, F.lit(high))) + margin
    limits = staged(known.groupBy("of__").agg(least.alias("low__"), most.alias("high__")), "limits")
    out = scored.join(F.broadcast(limits), F.col("lang").cast("string") == F.col("of__"), "left")  # one row a language
    slack = F.lit(SLACK) / F.sqrt(F.greatest("n_bytes__", F.lit(1)))
    keep = (F.col("n_bytes__") > 0) & (F.col("log_perplexity__").isNull() | F.col("of__").isNull() | F.col("log_perplexity__").between(F.col("low__") - slack, F.col("high__") + slack))
    return out.withColumn("keep__", keep).drop("of__")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, low: float = LOW, high: float = HIGH, margin: float = MARGIN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, n_bytes, log_perplexity, low, high, keep of every row."""
    source = _source(docs)
    names = {"n_bytes__": "n_bytes", "log_perplexity__": "log_perplexity", "low__": "low", "high__": "high", "keep__": "keep"}
    return _classified(source, labels, order, low, high, margin, block_bytes, ["doc_id", "lang"]).select("doc_id", "lang", *[F.col(a).alias(b) for a, b in names.items()])


def accepted(docs: DataFrame, labels: DataFrame, order: int = ORDER, low: float = LOW, high: float = HIGH, margin: float = MARGIN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return _classified(docs, labels, order, low, high, margin, block_bytes).where("keep__").select(*docs.columns)

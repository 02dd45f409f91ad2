"""Personal data: fixed patterns, and terms that by corpus co-occurrence give a protected entity away.

Patterns find emails, IP addresses, card and phone numbers, leftmost and without overlap within a kind; those that
fail a check (parts over 255, Luhn, number of digits) are dropped. They are written so that the regular expression
engine neither backtracks nor recurses over long runs, with the same matches.

The protected entities are the strings found and, besides the fixed kinds, secrets that are assigned to a name such as
``token``. A term is a word that stands within ``window`` words of an entity on its line. With counts of lines, an
observer who sees the term names the entity with p(e|t) = n(e, t) / (n(t) + 1), a frequency corrected for what a small
count can't show. The term's information about the entity is PMI = log2(p(e|t) / p(e)), the entity's own is
IC = -log2 p(e); a term discloses it where PMI >= IC - ``slack`` bits, that is n(e, t) * 2 ** slack >= n(t) + 1. With
the slack of one bit the observer's odds are at least even; a word that is only ever seen beside one entity discloses
it, one that stands elsewhere as often doesn't. An entity that is in every line has nothing to disclose. In documents that
hold the entity such terms are generalised to a placeholder, as the entity is, wherever they stand. Copies of a line
weigh alike in all counts, which are over all lines of all documents; only DataFrame functions run.

Defined cases: a null text is an empty one, without spans; overlapping spans of different kinds are all reported, and
their union is replaced, under the name of the first; rows are told apart whatever their doc_id, null included;
repeated rows give repeated results; an empty table gives an empty result. Other columns are left as they are; names
that end in two underscores are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.store import staged

#: Words on each side of an entity that are its context, and bits by which a term may tell less than all.
WINDOW, SLACK = 5, 1.0
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
_LOCAL, _HOST = r"A-Za-z0-9._%+-", r"[A-Za-z0-9-]++"
#: The kinds, in order, and what they look like.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@{_HOST}(?:\.{_HOST})++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else is protected: values assigned to names of secrets.
SECRET_NAMES = ("token", "secret", "password", "api_key")
SECRET = rf"(?:{'|'.join(SECRET_NAMES)})[\x20]*[=:][\x20]*\"?[A-Za-z0-9+/_-]{{16,}}\"?"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_HINT = {"email": "@", "ip": ".", "phone": "+"}
#: Documents with terms whose spans are sent to every task; more are joined by a shuffle, with the same result.
MOST_ROWS = 20_000
_SPANS = "array<struct<start:long,rank:int,stop:long,kind:string,found:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    seen = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("double"))

    def step(acc: Column, d: Column) -> Column:
        value = F.ascii(F.when(acc["double"], F.translate(d, "0123456789", "0246813579")).otherwise(d)) - 48
        return F.struct((acc["sum"] + value).alias("sum"), (~acc["double"]).alias("double"))

    return F.aggregate(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), seen, step, lambda acc: acc["sum"] % 10 == 0)


def _holds(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike("^" + r"\.".join([_PART] * 4) + "$")
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(12, 19), _luhn(_digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, pattern: Column | str, kind: str, rank: int) -> Column:
    """Where the pattern matches and its check holds. Pieces between matches and the matches themselves alternate, so
    their lengths, in code points, give the places."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    seen = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        stop = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"), x["hit"].alias("found"))
        return F.struct(stop.alias("at"), F.when(_holds(kind, x["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    both = F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("piece"), hits.alias("hit"))
    found = F.aggregate(both, seen, step, lambda acc: acc["out"])
    if kind == "card":
        likely = text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
    elif kind == "secret":
        likely = F.greatest(*[F.contains(text, F.lit(name)) for name in SECRET_NAMES])
    elif kind in _HINT:
        likely = F.contains(text, F.lit(_HINT[kind]))
    else:
        return found
    return F.when(likely, found).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    return F.array_sort(F.concat(*[_spans(text, p, kind, k) for k, (kind, p) in enumerate(PATTERNS.items())]))


def protected_spans(text: Column, base: Column) -> Column:
    """Base spans and those of secrets, by start, then kind."""
    return F.array_sort(F.concat(base, _spans(text, SECRET, "secret", len(PATTERNS))))


def _text(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))


def masked(text: Column, spans: Column) -> Column:
    """The text with the union of spans replaced by <KIND>."""
    seen = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(kept, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, seen, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans; all places stay."""
    seen = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = F.greatest(acc["at"], s["start"])
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int"))
        stop = F.greatest(start, s["stop"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], kept, F.repeat(F.lit(" "), (stop - start).cast("int"))).alias("out"))

    return F.aggregate(spans, seen, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def _entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["found"])


def _scanned(docs: DataFrame, whole: bool) -> DataFrame:
    """All columns, row__, base__, protected__ and n_lines__, staged: the one pass that looks for patterns. Where not
    ``whole``, texts without spans aren't kept."""
    base = docs.withColumn("base__", base_spans(_text())).withColumn("protected__", protected_spans(_text(), F.col("base__")))
    out = base.withColumn("n_lines__", F.size(F.split(_text(), "\n", -1)).cast("long")).withColumn("row__", F.monotonically_increasing_id())
    if not whole:
        out = out.withColumn("text", F.when(F.size("protected__") > 0, F.col("text")))
    return staged(out, "scanned")


def disclosures(docs: DataFrame, scanned: DataFrame | None = None, window: int = WINDOW, slack: float = SLACK) -> DataFrame:
    """entity, term, n_et, n_e, n_t: the terms that give an entity away, and the lines that hold both, the entity, the
    term. Entities are written as kind:string."""
    scanned = _scanned(docs.select("text"), False) if scanned is None else scanned
    lines = scanned.where(F.size("protected__") > 0).select(F.explode(F.split(_text(), "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    line = F.col("line")
    lines = lines.select("line", "n", protected_spans(line, base_spans(line)).alias("spans")).where(F.size("spans") > 0)
    lines = lines.select("n", "spans", _blanked(line, F.col("spans")).alias("bare"))

    def terms(s: Column) -> Column:
        before = _words(F.substring(F.col("bare"), F.lit(1), s["start"].cast("int")))
        after = _words(F.substring(F.col("bare"), (s["stop"] + 1).cast("int"), F.length("bare")))
        some = F.greatest(F.size(before) - window + 1, F.lit(1))
        return F.transform(F.concat(F.slice(before, some, window), F.slice(after, 1, window)), lambda t: F.struct(_entity(s).alias("entity"), t.alias("term")))

    lines = staged(lines.select("n", F.array_distinct(F.transform("spans", _entity)).alias("entities"), F.array_distinct(F.flatten(F.transform("spans", terms))).alias("beside")), "lines")
    entity = lines.select("n", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("n").alias("n_e"))
    pairs = staged(lines.select("n", F.explode("beside").alias("p")).groupBy("p.entity", "p.term").agg(F.sum("n").alias("n_et")), "pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", "n_et", F.col("n_et").alias("n_e"), F.col("n_et").alias("n_t"))
    every = docs.select(F.explode(F.split(_text(), "\n", -1)).alias("line")).select(F.explode(F.array_distinct(_words(F.col("line")))).alias("term"))
    counted = every.groupBy("term").agg(F.count("*").alias("n_t")).join(pairs.select("term").distinct(), "term", "left_semi")
    total = scanned.agg(F.sum("n_lines__")).collect()[0][0]
    told = pairs.join(counted, "term").where(F.col("n_et") * F.lit(2.0**slack) >= F.col("n_t") + 1).join(entity, "entity").where(F.col("n_e") < total)
    return staged(told.select("entity", "term", "n_et", "n_e", "n_t"), "disclosures")


def _found(docs: DataFrame, whole: bool, window: int, slack: float) -> DataFrame:
    """The scanned rows, and spans__: protected spans and those of terms, by start, then kind."""
    out = _scanned(docs, whole)
    told = disclosures(docs, out, window, slack)
    held = out.where(F.size("protected__") > 0)
    entities = held.select("row__", F.explode(F.array_distinct(F.transform("protected__", _entity))).alias("entity"))
    terms = entities.join(told.select("entity", "term"), "entity").groupBy("row__").agg(F.array_sort(F.collect_set("term")).alias("terms__"))
    inside = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pattern = F.concat(F.lit(f"(?i)(?<!{inside})(?:"), F.array_join("terms__", "|"), F.lit(f")(?!{inside})"))
    found = held.select("row__", "text", "protected__").join(terms.select("row__", pattern.alias("pattern__")), "row__")
    hits = _spans(_text(), F.col("pattern__"), "term", len(PATTERNS) + 1)
    clear = F.filter(hits, lambda t: ~F.exists("protected__", lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    found = staged(found.select("row__", clear.alias("terms__")), "terms")
    out = out.join(F.broadcast(found) if found.count() <= MOST_ROWS else found, "row__", "left")
    none = F.array().cast(_SPANS)
    return out.withColumn("spans__", F.array_sort(F.concat("protected__", F.coalesce("terms__", none))))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, window: int = WINDOW, slack: float = SLACK) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secrets, n_terms."""
    found = _found(docs.select("doc_id", "text"), False, window, slack)
    number = lambda c, kind: F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("long")
    more = [number("spans__", kind).alias(f"n_{kind}s") for kind in ("secret", "term")]
    return found.select("doc_id", *[number("base__", kind).alias(f"n_{kind}") for kind in PATTERNS], F.sha2(_written(F.col("base__")), 256).alias("base_sha256"), _written(F.col("spans__")).alias("spans"), *more)


def sanitise(docs: DataFrame, window: int = WINDOW, slack: float = SLACK) -> DataFrame:
    """The same rows and columns, with spans in the text replaced by placeholders; null texts stay null."""
    found = _found(docs, True, window, slack)
    text = F.when(F.size("spans__") > 0, masked(F.col("text"), F.col("spans__"))).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)

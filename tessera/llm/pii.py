"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that give them away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. The patterns are written so that a search starts
only where a maximal run of their characters does, which finds the same spans without rescanning long runs. Matches' places
follow from the lengths of the matches and of the pieces between them.

Terms: the corpus says how strongly a word t reveals a protected value e. With documents as events, N of them in all, n_e
with the value, n_t with the word anywhere and n_te with the word at most REACH letters from the value, n_te / n_t estimates
how likely the value is given the word, and log2(n_te N / (n_t n_e)) is the information in bits that the word gives. What
decides is the lower bound of that estimate (Wilson's, one-sided, Z standard errors), so that a word that stood by a value once
or twice proves nothing. Copies of a document are one observation, not many: documents are weighed by their contexts. A context
is the passage around the value; a short one (under CONTEXT_WORDS words) counts by all its letters, a long one by the smallest
hash of its words, which near copies share. With c_k documents in context k the bound takes n_te**2 / sum(c_k**2) documents
for n_te (Kish's effective size) and as many times fewer for n_t. A word is disclosing if by that bound it leaves at most LEFT_BITS
of the value's own information, log2(N / n_e), unrevealed, and reveals at least BITS; three contexts are the fewest that can do.
Nothing else decides. A disclosing word becomes a `term` span wherever it stands in the documents that hold it near the value.
`sanitise` generalises base spans to their kind and words with digits to [CODE], and removes other terms.

Counts: pairs of word and value come from the documents with values only. Those that even there miss the threshold go first
(fewer other documents only raise the bound); the words of all documents are then counted for the terms that are left: these
are broadcast to them if few, and joined with counts of all words by hash if not. Values in more than N / 2**BITS documents can't
be revealed and leave at once.

Nulls and edges: a null text is empty; a null id is kept; repeated rows count as copies and are marked each; an empty table gives
an empty result; in fewer than 2**BITS documents nothing is disclosing. Extra columns, whatever their names, are ignored or, in
`sanitise`, kept. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Scratch, ascii_lower, let, starts

#: The kinds in order and their patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Letters before and after a value among which words are looked for, whole ones, in its own line or others.
REACH = 200
#: Bits of a value's information that a disclosing word may leave open, and bits that it must give.
LEFT_BITS, BITS = 1.0, 3.0
#: Standard errors by which the bound is lower than the estimate: 95 per cent of confidence.
Z = 1.645
#: Distinct words from which a passage is known by the smallest hash of its words.
CONTEXT_WORDS = 20
#: Terms up to this number are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Long texts are cut into pieces of so many letters, from which parts are taken.
PIECE = 1000

_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, n: Column) -> Column:
    """Substring of the text that was cut into pieces, without going through all of it; empty for n < 1."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((start + n - 1) / PIECE).cast("int")
    return F.when(n > 0, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * PIECE + 1, n)).otherwise("")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """What a match must satisfy besides its pattern."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, "\\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Spans of one kind, by start: matches between the pieces that splitting leaves."""
    pattern = PATTERNS[kind]

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        before = starts(F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda z: F.coalesce(z["g"], F.lit(0)) + F.coalesce(F.length(z["m"]), F.lit(0))))
        one = lambda z: F.struct(F.lit(kind).alias("kind"), (z["b"] + z["g"]).alias("start"), (z["b"] + z["g"] + F.length(z["m"])).alias("end"), z["m"].alias("value"))
        kept = F.filter(F.arrays_zip(found.alias("m"), gaps.alias("g"), before.alias("b")), lambda z: z["m"].isNotNull() & F.coalesce(_holds(kind, z["m"]), F.lit(False)))
        return F.transform(kept, one).cast(_SPAN)

    maybe = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]\\.[0-9]" if kind == "ip" else "[0-9]{2}|[0-9][\\x20-][0-9]"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(maybe & text.rlike(pattern), let(found, placed)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All base spans, by kind and start."""
    return F.concat(*[_spans(text, kind) for kind in KINDS])


def _plain(word: Column) -> Column:
    """A term: the word without punctuation at its ends, lower-cased."""
    return ascii_lower(F.regexp_replace(word, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))


def _is_term(word: Column) -> Column:
    """Words with a letter; not addresses, which are values themselves."""
    return word.rlike("\\p{L}") & ~F.contains(word, F.lit("@"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _context(terms: Column, left: Column, right: Column) -> Column:
    """What copies of a passage share: its letters if it is short, else the smallest hash of its words."""
    return F.when(F.size(terms) < CONTEXT_WORDS, F.xxhash64(left, right)).otherwise(F.array_min(F.transform(terms, lambda t: F.xxhash64(t))))


def _passages(text: Column, spans: Column) -> Column:
    """For each span its value and the distinct terms at most REACH letters before or after it."""

    def one(s: Column, pieces: Column) -> Column:
        begin = F.greatest(s["start"] - REACH, F.lit(0))
        left, right = _cut(pieces, begin, s["start"] - begin), _cut(pieces, s["end"], F.lit(REACH))
        # Words that the reach cuts through are left out.
        left = F.when(begin > 0, F.regexp_replace(left, f"^{WORD}", "")).otherwise(left)
        right = F.when(F.length(right) == REACH, F.regexp_replace(right, f"{WORD}$", "")).otherwise(right)
        value = F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(F.regexp_replace(s["value"], "[^0-9.]", ""))
        terms = F.filter(F.array_distinct(F.transform(F.concat(_words(left), _words(right)), _plain)), _is_term)
        return let(terms, lambda t: F.struct(F.concat_ws(":", s["kind"], value).alias("entity"), t.alias("terms"), _context(t, left, right).alias("context")))

    return let(_pieces(text), lambda p: F.transform(spans, lambda s: one(s, p)))


def bound(n_te: Column, n_t: Column, squares: Column) -> Column:
    """Least probability of the value given the word: n_te of n_t documents, the contexts' squared numbers of which sum to `squares`."""
    size = n_te.cast("double") * n_t / squares  # documents with the word, as many of them as contexts tell apart
    p, z2 = n_te / n_t, Z * Z
    return (p + z2 / (2 * size) - Z * F.sqrt(p * (1 - p) / size + z2 / (4 * size * size))) / (1 + z2 / size)


def _telling(s: Scratch, near: DataFrame, n: int, texts: DataFrame) -> DataFrame:
    """Written (entity, term): disclosing pairs among near (rid, entity, term, context), a row for each of the first three; texts: all of the corpus."""
    holders = near.select("rid", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") * 2**BITS <= n)
    seen = near.select("rid", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    contexts = near.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("c"))
    pairs = contexts.groupBy("entity", "term").agg(F.sum("c").alias("n_te"), F.sum(F.col("c").cast("double") * F.col("c")).alias("squares")).join(holders, "entity")
    least = bound(F.col("n_te"), F.col("n_t"), F.col("squares"))
    strong = (least * 2**LEFT_BITS >= 1) & (F.log2(least * F.lit(float(n)) / F.col("n_e")) >= BITS)
    pairs = s.write(pairs.join(seen, "term").where(strong).drop("n_t").withColumn("h", F.xxhash64("term")), "pii-pairs")
    hashes = pairs.select("h").distinct()
    terms = hashes.count()
    if not terms:
        return pairs.select("entity", "term")
    every = texts.select(F.explode(F.array_distinct(F.transform(_words(F.col("text")), lambda w: F.xxhash64(_plain(w))))).alias("h"))
    if terms <= BROADCAST_ROWS:
        every = every.join(F.broadcast(hashes), "h", "left_semi")
    counts = every.groupBy("h").agg(F.count(F.lit(1)).alias("n_t"))
    return s.write(pairs.join(counts, "h").where(strong).select("entity", "term"), "pii-telling")


def detect(s: Scratch, docs: DataFrame, columns: list[str]) -> DataFrame:
    """(row, base, terms): the given columns of each row as a struct, its base spans, its spans of kind `term`; from tables of s."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text.alias("text"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    marked = F.size("base") > 0
    rows = s.write(rows.select("row", "rid", "base", F.when(marked, F.col("text")).alias("text"), F.when(marked, _passages(F.col("text"), F.col("base"))).alias("passages")), "pii-rows")

    near = rows.where(F.size("base") > 0).select("rid", F.explode("passages").alias("p")).select("rid", "p.entity", "p.context", F.explode("p.terms").alias("term"))
    near = near.groupBy("rid", "entity", "term").agg(F.min("context").alias("context"))
    near = s.write(near, "pii-near")
    telling = _telling(s, near, rows.count(), docs.select(text.alias("text")))
    n = telling.count()
    none = F.array().cast(_SPAN)
    if not n:
        return rows.select("row", "base", none.alias("terms"))
    hits = s.write(near.join(F.broadcast(telling) if n <= BROADCAST_ROWS else telling, ["entity", "term"]).select("rid", "term").distinct(), "pii-hits")

    # Words of the documents with hits, with their places.
    held = rows.select("rid", "text").join(hits.select("rid").distinct(), "rid")
    parts = F.split("text", "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])", -1)
    placed = let(parts, lambda p: F.arrays_zip(p.alias("part"), starts(F.transform(p, F.length)).alias("at")))
    words = held.select("rid", F.explode(placed).alias("w")).select("rid", "w.at", F.regexp_replace("w.part", "[\\x20\\x09-\\x0D]+$", "").alias("bare"))
    words = words.select("rid", (F.col("at") + F.length("bare") - F.length(F.regexp_replace("bare", "^[^\\p{L}\\p{N}]+", ""))).alias("start"), _plain(F.col("bare")).alias("term"))
    span = F.struct(F.lit("term").alias("kind"), F.col("start"), (F.col("start") + F.length("term")).alias("end"), F.col("term").alias("value"))
    spans = words.join(hits, ["rid", "term"]).groupBy("rid").agg(F.sort_array(F.collect_list(span)).cast(_SPAN).alias("terms"))
    spans = s.write(spans, "pii-terms")
    return rows.join(spans, "rid", "left").select("row", "base", F.coalesce("terms", none).alias("terms"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, a count of each kind, base_sha256, spans, n_term."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    with Scratch(docs.sparkSession) as s:
        found = detect(s, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
        return s.out(found.select("row.doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_term")), "pii-digest")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with base spans generalised to [EMAIL], [IP], ..., disclosing terms with digits to [CODE], other terms removed."""
    columns = docs.columns
    order = F.array_sort(F.concat("base", "terms"), lambda a, b: F.when(a["start"] != b["start"], F.signum((a["start"] - b["start"]).cast("double")).cast("int")).otherwise(F.signum((b["end"] - a["end"]).cast("double")).cast("int")))
    text = F.col("row.text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(pieces: Column, a: Column, s: Column) -> Column:
        mark = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["value"].rlike("[0-9]"), "[CODE]").otherwise("")
        new = F.struct(s["end"].alias("at"), F.concat(a["out"], _cut(pieces, a["at"], s["start"] - a["at"]), mark).alias("out"))
        return F.when(s["start"] >= a["at"], new).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    done = let(_pieces(text), lambda p: F.aggregate(order, zero, lambda a, x: step(p, a, x), lambda a: F.concat(a["out"], _cut(p, a["at"], F.length(text) - a["at"]))))
    with Scratch(docs.sparkSession) as s:
        found = detect(s, docs, columns)
        new = F.when(F.size("base") + F.size("terms") > 0, done).otherwise(text)
        return s.out(found.select(*[new.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in columns]), "pii-sanitised")

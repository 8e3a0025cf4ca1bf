"""Personal data, and terms that give it away (operator 2).

Everything here is DataFrame functions; no Python runs on the executors.

Entities (e-mail, ip, card and phone numbers) are found by pattern.  The terms
around them are then weighed over the whole corpus.  With n(t) the occurrences
of a term and n(t, e) those beside an entity e, the share n(t, e) / n(t) estimates
how surely the term reveals e; its lower confidence bound (Wilson) must reach
``MIN_SHARE``, and it must be ``MIN_BITS`` above what e's frequency explains.  How sure
the share is depends on the different texts that show it, not on occurrences:
copies of a text count once, and so do the same surroundings of the same entity,
wherever they are repeated.  Neither a line that a text repeats nor a text with many
copies, exact or near, tells more than one text does.  e is
an entity by its value, such as one address, and also its kind, so that both a
surname and a label are weighed.  A term above the thresholds is reported
wherever it stands, in texts without any entity too.  ``sanitise`` removes the
surest terms, generalises the others to what they reveal, and replaces entities
by their kind.

Patterns use possessive runs and a left edge, so that each text is scanned in
linear time; they find what the plain leftmost patterns find.

Defined results: a null text is an empty text.  Rows that repeat an id are
treated each on its own.  Spans count code points, ends are exclusive; terms that
overlap an entity aren't reported.  Extra columns are ignored; ``sanitise``
returns ``doc_id`` and ``text``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.llm.store import discard, written

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
TERM = r"\p{L}[\p{L}\p{N}_]++"
#: Code points on either side of an entity whose terms stand beside it.
AROUND = 96
#: Least bits, and least lower bound (at ``_Z`` standard errors) of the share of a term's occurrences beside what it reveals.
MIN_BITS, MIN_SHARE = 4.0, 0.5
_Z = 1.645
REMOVE_SHARE = 0.9
#: Telling terms are broadcast up to this number, and joined by shuffle beyond it.
BROADCAST_TERMS = 100_000
#: Places are summed in runs of so many matches.
_RUN = 256


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once however often it is used there."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _matches(text: Column, pattern: str, around: bool = False) -> Column:
    """Start, end and string of each match, in code points, as an array of structs.

    The gaps between matches give their places.  Their sums are taken in runs, and
    within a run, so that a text with very many matches takes little more than linear time.
    ``around`` adds what stands before and after, up to the next match or ``AROUND``.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def placed(found: Column, gap: Column, step: Column) -> Column:
        run = F.sequence(F.lit(0), F.floor(F.size(step) / _RUN).cast("int"))
        sums = F.transform(run, lambda r: total(F.slice(step, r * _RUN + 1, F.lit(_RUN))))

        def at(before: Column) -> Column:
            def one(match: Column, i: Column) -> Column:
                r = F.floor(i / _RUN).cast("int")
                start = F.element_at(before, r + 1) + total(F.slice(step, r * _RUN + 1, i - r * _RUN + 1))
                fields = [start.cast("long").alias("start"), (start + F.length(match)).cast("long").alias("end"), match.alias("match")]
                if around:
                    left, right = F.element_at(gap, i + 1), F.element_at(gap, i + 2)
                    # A word that the edge of what is looked at may have cut doesn't count.
                    fields += [
                        F.when(F.length(left) > AROUND, F.regexp_replace(F.right(left, F.lit(AROUND)), r"^[\p{L}\p{N}_]+", "")).otherwise(left).alias("before"),
                        F.when(F.length(right) > AROUND, F.regexp_replace(F.left(right, F.lit(AROUND)), r"[\p{L}\p{N}_]+$", "")).otherwise(right).alias("after"),
                    ]
                return F.struct(*fields)

            return F.transform(found, one)

        return _let(sums, lambda s: _let(F.transform(s, lambda _, r: total(F.slice(s, F.lit(1), r))), at))

    def steps(found: Column, gap: Column) -> Column:
        # From the start of one match to that of the next: its own length and the gap behind it.
        size = F.concat(F.array(F.lit(0)), F.transform(found, lambda m: F.length(m)))
        step = F.zip_with(F.transform(gap, lambda x: F.length(x)), size, lambda x, y: x + y)
        return _let(step, lambda s: placed(found, gap, s))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _let(F.split(text, pattern, -1), lambda gap: steps(found, gap)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(_IP_PARTS),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & _luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}
#: Cheap tests that a text must pass before its pattern is tried.
_MAY = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\."),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"),
    "phone": lambda t: t.contains("+"),
}
_ENTITIES = "array<struct<kind:string,start:bigint,end:bigint,entity:bigint,before:string,after:string>>"


def entities(text: Column) -> Column:
    """Valid entities of a text, by kind and then start: kind, start, end, entity (a hash of its value), and what stands before and after."""

    def of(kind: str) -> Column:
        valid = F.filter(_matches(text, PATTERNS[kind], around=True), lambda m: _VALID[kind](m["match"]))
        value = (lambda m: F.lower(m)) if kind == "email" else (lambda m: m) if kind == "ip" else _digits
        spans = F.transform(valid, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.xxhash64(F.lit(kind), value(m["match"])).alias("entity"), m["before"].alias("before"), m["after"].alias("after")))
        return F.when(_MAY[kind](text), spans).otherwise(F.array().cast(_ENTITIES))

    return F.concat(*[of(k) for k in PATTERNS])


def _terms_beside(span: Column) -> Column:
    """The terms near an entity; words of other addresses are none."""
    plain = F.regexp_replace(F.concat(span["before"], F.lit(" "), span["after"]), PATTERNS["email"], " ")
    # The same entity in the same surroundings is one sighting, however many texts repeat it.
    one = lambda terms, seen: F.transform(terms, lambda t: F.struct(span["kind"].alias("kind"), span["entity"].alias("entity"), seen.alias("sighting"), t.alias("term")))
    return _let(F.regexp_extract_all(F.lower(plain), F.lit(TERM), F.lit(0)), lambda terms: _let(F.xxhash64(span["entity"], terms), lambda seen: one(terms, seen)))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # An id and a hash of the text name a row; rows that agree in both have the same terms.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def find_entities(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Written table: doc_id, hash, spans, near terms (and text)."""
    def both(every: Column) -> Column:
        spans = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.struct(spans.alias("spans"), F.flatten(F.transform(every, _terms_beside)).alias("near"))

    found = _texts(docs).withColumn("found", _let(entities(F.col("text")), both))
    # Entities are found once: the table is written with both in one column.
    out = written(found if with_text else found.drop("text"), "entities")
    return out.select("doc_id", "hash", *(["text"] if with_text else []), "found.spans", "found.near")


def _words(text: Column) -> Column:
    plain = F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.regexp_extract_all(F.lower(plain), F.lit(TERM), F.lit(0))


def disclosure(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Written table of the telling terms: term, kind of what it reveals, share (its lower bound), bits."""
    # Every count combines before it is shuffled, so a frequent word is a row per task.
    pairs = found.select("hash", F.explode("near").alias("x")).select("hash", "x.term", "x.kind", "x.sighting", F.explode(F.array("x.entity", F.xxhash64("x.kind"))).alias("target"))
    once = pairs.groupBy("term", "kind", "target", "sighting").agg(F.count("*").alias("n"), F.min("hash").alias("hash"))
    beside = written(once.groupBy("term", "kind", "target").agg(F.sum("n").alias("n_near"), F.countDistinct("hash").alias("texts_near")), "beside")
    counts = _texts(docs).select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = written(counts, "terms")
    words = total.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    k = F.least("n_near", "n")
    p = k / F.col("n")
    # So many different texts, of which the share p has the term beside the entity, are what the counts rest on.
    n = F.col("texts_near") / p
    low = (p + _Z**2 / (2 * n) - _Z * F.sqrt(p * (1 - p) / n + _Z**2 / (4 * n * n))) / (1 + _Z**2 / n)
    sure = beside.join(total, "term").withColumn("share", low).where(F.col("share") >= MIN_SHARE)
    places = beside.groupBy("target").agg(F.sum("n_near").alias("places"))
    bits = F.log2(p) - F.log2(F.col("places") / F.lit(max(1, words)))
    telling = sure.join(places, "target").withColumn("bits", bits).where(F.col("bits") >= MIN_BITS)
    best = telling.groupBy("term").agg(F.max(F.struct("share", "bits", "kind")).alias("b")).select("term", "b.kind", "b.share", "b.bits")
    out = written(best, "telling")
    discard(beside, total)
    return out


def _telling_spans(docs: DataFrame, found: DataFrame, telling: DataFrame) -> DataFrame:
    """doc_id, hash and terms (start, end, share, reveals) of the rows that hold telling terms."""
    texts = _texts(docs)
    some = F.broadcast(telling) if telling.count() <= BROADCAST_TERMS else telling
    known = texts.select("doc_id", "hash", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).join(some.select("term", "share", "kind"), "term")
    # A row's terms are bounded by its text.
    known = written(known.distinct().groupBy("doc_id", "hash").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("share", "kind")))).alias("known")), "telling-rows")
    a, b = texts.alias("a"), known.alias("b")
    held = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.hash") == F.col("b.hash"))).select("a.doc_id", "a.hash", "text", "known").dropDuplicates(["doc_id", "hash"])
    match = F.filter(F.transform(_matches(F.col("text"), TERM), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.col("known")[F.lower(m["match"])].alias("of"))), lambda m: m["of"].isNotNull())
    terms = held.select("doc_id", "hash", F.explode(match).alias("m")).select("doc_id", "hash", "m.start", "m.end", F.col("m.of.share").alias("share"), F.col("m.of.kind").alias("reveals"))
    a, b = found.alias("a"), known.alias("b")
    taken = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.hash") == F.col("b.hash"))).select("a.doc_id", "a.hash", F.explode("spans").alias("s")).select("doc_id", "hash", "s.start", "s.end", F.lit(None).cast("double").alias("share"), F.lit(None).cast("string").alias("reveals"))
    # One sweep over a text: a term is clear of entities that begin before it and of the next one.
    order = Window.partitionBy("doc_id", "hash").orderBy("start", F.col("share").isNotNull())
    entity = F.col("share").isNull()
    before = F.max(F.when(entity, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(entity, F.col("start")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    swept = terms.unionByName(taken).select("*", before.alias("before"), after.alias("after"))
    clear = swept.where(~entity & (F.coalesce("before", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True)))
    return clear.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(F.struct("start", "end", "share", "reveals"))).alias("terms"))


def find_pii(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id and spans (kind, start, end, share, reveals) by kind and start; terms come last.

    ``share`` is how surely a term reveals an entity of the kind ``reveals``; of entities both are null.
    """
    found = find_entities(docs, with_text)
    terms = _telling_spans(docs, found, disclosure(docs, found))
    listed = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["share"].alias("share"), t["reveals"].alias("reveals")))
    none = lambda t: F.lit(None).cast(t)
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), none("double").alias("share"), none("string").alias("reveals")))
    span = "array<struct<kind:string,start:bigint,end:bigint,share:double,reveals:string>>"
    a, b = found.alias("a"), terms.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.hash") == F.col("b.hash")), "left")
    return both.select("a.doc_id", *(["text"] if with_text else []), F.concat(base, F.coalesce(listed, F.array().cast(span))).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with entities replaced by their kind and telling terms removed or generalised to what they reveal."""
    found = find_pii(docs, with_text=True)
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["share"].alias("share"), s["reveals"].alias("reveals"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        mask = F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(s["share"] >= REMOVE_SHARE, F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(s["reveals"]), F.lit(" TERM>")))
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, mask).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(ordered, start, put)
    return found.withColumn("done", done).select("doc_id", F.concat(F.col("done.out"), F.substring("text", (F.col("done.at") + 1).cast("int"), F.length("text"))).alias("text"))

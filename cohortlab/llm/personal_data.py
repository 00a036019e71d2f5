"""Personal data by weak supervision (operator 7, DataFrame functions only).

Candidates are the base matches of the contract (e-mail, IP address, card, phone), the
matches that fail its tests, and looser forms (obfuscated addresses, local phone
numbers).  Five labelers vote for (2), against (0) or abstain (1) on each candidate:

* pattern: the strict pattern and its test;
* gazetteer: top-level domains, reserved address blocks, card issuers, dialling codes;
* context: cue words in the 40 characters before;
* boundary: what stands directly before and after;
* structure: number of digits, checksum, length of the domain.

Per kind, expectation-maximisation over the counts of vote patterns (at most 3^5)
estimates each labeler's behaviour on true and false candidates; the resulting
probabilities train the span classifier, a naive Bayes model over the words before and
after, the shape, and the votes.  Base matches stay as they are; the classifier adds
other candidates that score at least 0.9 and overlap no base match.

Scale: one pass over whole texts writes each row's candidates; the model is learnt from
counts of patterns and hashed features (fixed numbers of both) and applied to each row
in place.  No row of text is shuffled.

Edge cases: null and empty texts have no spans; without candidates of a kind nothing is
learnt or added for it; repeated rows count in the statistics and are reported alike;
null ids are kept; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm._spans import bound, matches
from cohortlab.llm._tables import stage

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "boundary", "structure")
CUES = {"email": "mail|contact|write|kontakt|courriel|correo", "ip": r"\bip\b|host|server|address|adresse",
        "card": "card|visa|credit|karte|carte|tarjeta", "phone": "call|tel|phone|fax|mobil"}
COUNTER_CUES = "version|isbn|order|invoice|section|chapter"

# Possessive repeats keep the matcher from trying a run again from each of its places;
# the look-behind (or the end of the last match) starts a run once only.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LOOSE = {"email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,63}+"
                  r"(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z]{2,24}+){1,4}",
         "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"}


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def strict(kind: str, found: Column) -> Column:
    """The contract's test of a base match."""
    if kind == "ip":
        return found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return bound(digits(found), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(found)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "2").when(no, "0").otherwise("1")


def votes(kind: str, m: Column, before: Column, after: Column, base: Column) -> Column:
    found, number = m["found"], digits(m["found"])
    always, never = F.lit(True), F.lit(False)
    gazetteer = {
        "email": (found.rlike(r"(?i)(?:\.|dot[)\]]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|eu|uk|it|nl|ch|at)$"), always),
        "ip": (never, found.rlike(r"^(?:0+|127|255)\.|^(?:[0-9]\.){3}[0-9]$")),
        "card": (number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"), always),
        "phone": (number.rlike("^(?:1|33|34|39|4[1-9]|7|81|86|91)"), found.startswith("+")),
    }[kind]
    structure = {
        "email": (found.rlike(r"[A-Za-z]{2,24}$"), always), "ip": (strict("ip", found), always),
        "card": (strict("card", found), ~F.length(number).between(13, 19)),
        "phone": (F.length(number).between(10, 13), ~F.length(number).between(7, 15)),
    }[kind]
    near = F.lower(before)
    context = (near.rlike(CUES[kind]), near.rlike(COUNTER_CUES))
    edge = F.concat(F.substring(before, -1, 1), F.lit("|"), F.substring(after, 1, 1))
    boundary = (edge.rlike(r"^[\s(<:,;\"']?\|[\s)>:,;.!?\"']?$"), edge.rlike(r"[A-Za-z0-9_=/]"))
    return F.concat(_vote(base, ~base), *[_vote(*v) for v in (gazetteer, context, boundary, structure)])


def features(kind: str, m: Column, before: Column, after: Column, pattern: Column) -> Column:
    bucket = lambda side, text: F.concat(F.lit(side), F.pmod(F.xxhash64(F.lower(text)), F.lit(128)).cast("string"))
    left = F.regexp_extract(before, r"(\S+)\s*$", 1)
    right = F.regexp_extract(after, r"^\s*(\S+)", 1)
    shape = F.concat(F.lit("s"), F.least(F.length(m["found"]), F.lit(40)).cast("string"), F.lit("d"),
                     F.least(F.length(digits(m["found"])), F.lit(20)).cast("string"))
    voted = [F.concat(F.lit(f"v{k}"), F.substring(pattern, k + 1, 1)) for k in range(1, len(LABELERS))]
    return F.array(bucket("l", left), bucket("r", right), shape, *voted)


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, base, votes, features>> of a text."""
    def of(kind: str, pattern: str, loose: bool) -> Column:
        found = matches(text, pattern)
        if kind == "card":        # other runs of digits are no candidates
            found = F.filter(found, lambda m: F.length(digits(m["found"])).between(13, 19))

        def made(m: Column) -> Column:
            before = F.substring(text, F.greatest(m["start"] - 39, F.lit(1)).cast("int"),
                                 F.least(m["start"], F.lit(40)).cast("int"))
            after = F.substring(text, (m["end"] + 1).cast("int"), F.lit(24))
            voted = lambda b: bound(votes(kind, m, before, after, b), lambda v: F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), b.alias("base"),
                v.alias("votes"), features(kind, m, before, after, v).alias("features")))
            return bound(F.lit(False) if loose else strict(kind, m["found"]), voted)

        return F.transform(found, made)

    return F.concat(*[of(kind, pattern, False) for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE))],
                    *[of(kind, pattern, True) for kind, pattern in LOOSE.items()])


def _post(p: Column, prior: Column, one: Column, zero: Column) -> Column:
    """Probability that a candidate with vote pattern ``p`` (digits 0-2) is true."""
    def total(theta: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(LABELERS) - 1)), F.lit(0.0), lambda acc, k: acc + F.log(
            F.get(F.get(theta, k), F.substring(p, k + 1, F.lit(1)).cast("int"))))

    return 1 / (1 + F.exp(total(zero) - total(one)) * (1 - prior) / prior)


def estimate(found: DataFrame, rounds: int = 20) -> DataFrame:
    """(kind, votes, n, p): probability of each vote pattern after EM.

    ``found`` has one row per candidate (kind, votes).  A kind's patterns (at most 3^5)
    stand in one row, and the rounds are an aggregate over it.
    """
    per = found.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))
    rows = per.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    labeler = F.sequence(F.lit(0), F.lit(len(LABELERS) - 1))
    table = lambda a, b, c: F.transform(labeler, lambda _: F.array(F.lit(a), F.lit(b), F.lit(c)))
    start = F.struct(F.lit(0.5).alias("prior"), table(0.1, 0.3, 0.6).alias("one"), table(0.6, 0.3, 0.1).alias("zero"))

    def turn(state: Column, _: Column) -> Column:
        weighed = F.transform("patterns", lambda x: F.struct(
            x["votes"].alias("votes"),
            bound(_post(x["votes"], state["prior"], state["one"], state["zero"]),
                  lambda p: F.struct((x["n"] * p).alias("one"), (x["n"] * (1 - p)).alias("zero"))).alias("w")))

        def again(g: Column) -> Column:
            mass = lambda xs, side: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x["w"][side])
            theta = lambda side: bound(mass(g, side), lambda whole: F.transform(labeler, lambda k: F.transform(
                F.array(F.lit("0"), F.lit("1"), F.lit("2")), lambda v: (mass(F.filter(
                    g, lambda x: F.substring(x["votes"], k + 1, F.lit(1)) == v), side) + 1) / (whole + 3))))
            prior = bound(mass(g, "one"), lambda one: (one + 1) / (one + mass(g, "zero") + 2))
            return F.struct(prior.alias("prior"), theta("one").alias("one"), theta("zero").alias("zero"))

        return bound(weighed, again)

    fitted = rows.select("kind", "patterns", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn).alias("m"))
    return (fitted.select("kind", "m", F.explode("patterns").alias("x"))
            .select("kind", "x.votes", "x.n", _post(F.col("x.votes"), F.col("m.prior"), F.col("m.one"), F.col("m.zero")).alias("p")))


def span_model(found: DataFrame) -> DataFrame:
    """One row: (weights map<kind:feature, log odds>), the naive Bayes span classifier
    trained with the probabilities of :func:`estimate`.  The key ``kind:`` holds the prior."""
    known = stage(estimate(found), "pii-patterns").select("kind", "votes", "p")
    rows = found.join(known, ["kind", "votes"])
    part = F.explode(F.array_union(F.array(F.lit("")), F.col("features")))
    sums = (rows.select("kind", "p", part.alias("feature")).groupBy("kind", "feature")
            .agg(F.sum("p").alias("one"), F.sum(1 - F.col("p")).alias("zero")))
    whole = sums.filter("feature = ''").select("kind", F.col("one").alias("ones"), F.col("zero").alias("zeros"))
    odds = F.when(F.col("feature") == "", F.log((F.col("ones") + 1) / (F.col("zeros") + 1))).otherwise(
        F.log((F.col("one") + 1) / (F.col("ones") + 2)) - F.log((F.col("zero") + 1) / (F.col("zeros") + 2)))
    entries = sums.join(whole, "kind").select(F.struct(F.concat("kind", F.lit(":"), "feature").alias("key"), odds.alias("value")).alias("e"))
    # a fixed number of features for four kinds
    return entries.agg(F.map_from_entries(F.coalesce(F.collect_list("e"), F.expr(
        "cast(array() AS array<struct<key: string, value: double>>)"))).alias("weights"))


def candidate_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features")


def annotate(rows: DataFrame, model: DataFrame, least: float = 0.9) -> DataFrame:
    """Adds ``spans``: base matches and accepted candidates of ``found``, by kind, then start."""
    def odds(c: Column) -> Column:
        weight = lambda name: F.coalesce(F.element_at("weights", F.concat(c["kind"], F.lit(":"), name)), F.lit(0.0))
        return F.aggregate(c["features"], weight(F.lit("")), lambda acc, f: acc + weight(f))

    def chosen(found: Column) -> Column:
        base = F.filter(found, lambda c: c["base"])
        added = F.filter(found, lambda c: ~c["base"] & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
                         & (1 / (1 + F.exp(-odds(c))) >= least))
        rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
        return F.sort_array(F.transform(F.concat(base, added), lambda c: F.struct(
            rank(c["kind"]).cast("int").alias("rank"), c["start"].alias("start"), c["end"].alias("end"),
            c["kind"].alias("kind"), c["base"].alias("base"))))

    return rows.crossJoin(F.broadcast(model)).withColumn("spans", chosen(F.col("found"))).drop("weights")   # one row


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``; spans are structs of rank, start, end, kind, base."""
    rows = stage(docs.select("doc_id", candidates(F.coalesce("text", F.lit(""))).alias("found")), "pii-candidates")
    model = stage(span_model(candidate_rows(rows)), "pii-model")
    return annotate(rows, model).drop("found")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return find_personal_data(docs).select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                                           F.sha2(joined(base), 256).alias("base_sha256"),
                                           joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become
    one, named by the first.  ``n_chars`` (if there) is counted anew."""
    # the rows travel as one struct, so their columns may have any names; candidates are found once
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    seen = stage(docs.select(row.alias("row"), candidates(F.coalesce("text", F.lit(""))).alias("found")), "pii-texts")
    model = stage(span_model(candidate_rows(seen.filter(F.size("found") > 0))), "pii-model")
    text, size = F.coalesce("row.text", F.lit("")), F.size("spans")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def cut(acc: Column, s: Column) -> Column:
        upto = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.when(fresh, F.concat(acc["out"], upto, F.lit("["), F.upper(s["kind"]), F.lit("]")))
                        .otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    by_start = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    done = F.aggregate(by_start, zero, cut, lambda acc: F.concat(acc["out"], F.substring(
        text, (acc["at"] + 1).cast("int"), F.length(text))))
    rows = annotate(seen, model).withColumn("clean", F.when(size > 0, done).otherwise(F.col("row.text")))
    fresh = {"text": F.col("clean"),
             "n_chars": F.when(size > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

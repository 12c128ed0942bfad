"""Personal data by weak supervision, with DataFrame functions only.

Loose patterns propose spans. Three labelers vote on each: its format (regex and checks), a gazetteer
(known issuers, calling codes, endings, ranges) and the words before it. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is, and the posteriors train a
final classifier over the spans' shapes. Spans of the base rules are always kept.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written

# Patterns. Runs begin where no character of theirs stands before (or where the match before ended) and
# never give back what they took: the same leftmost matches as plain repetition, in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|(?:\x20?[A-Z0-9]{4}){2}\x20?[A-Z0-9]{3})(?![A-Z0-9])",
    "masked_email": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{1,63}(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[a-z0-9-]{1,63})*(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\.)[a-z]{2,10}(?![a-z])",
    "local_phone": r"(?<![0-9+(-])(?<!\+[0-9]{1,3}[\x20.-]?)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "secret": r"(?:(?<![A-Za-z0-9+/_=-])|(?<=[A-Za-z0-9_\])\x22'][=:])|(?<=[A-Za-z0-9_]=[\x22']))(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9=])",
    "address": r"(?<![\p{L}\p{N}])(?:[0-9]{1,5}\x20(?:[A-Z][a-z]+\x20){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct)|\p{Lu}\p{L}*(?:straße|strasse|gasse|platz|weg)\x20[0-9]{1,4}[a-z]?|[0-9]{1,4},?\x20(?:rue|avenue|boulevard)\x20(?:de\x20la\x20|de\x20|du\x20|des\x20)?\p{Lu}\p{L}+|(?:Calle|Avenida|Plaza)\x20(?:de\x20la\x20|de\x20|del\x20)?\p{Lu}\p{L}+,?\x20[0-9]{1,4})(?![\p{L}\p{N}])",
    "person": r"(?<![\p{L}\p{N}.@-])(?:James|John|Robert|Michael|William|David|Richard|Thomas|Mary|Patricia|Jennifer|Linda|Elizabeth|Susan|Sarah|Karen|Hans|Peter|Klaus|Wolfgang|Ursula|Monika|Jean|Pierre|Michel|Marie|Nathalie|Isabelle|Carlos|Juan|José|Luis|María|Carmen|Ana|Laura)\x20\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)?",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)

# What a text must contain one of for a pattern to be tried, as every match does; digits are tried everywhere.
MARKS = {"email": ("@",), "phone": ("+",), "masked_email": ("[", "(")}

# Fixed values of the gazetteer labeler.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "us", "no")
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38)"
CALLING_CODES = r"^\+ ?(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED_RANGES = r"^(0|10|127|169\.254|172\.(1[6-9]|2[0-9]|3[01])|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
SAMPLE_SSNS = ("078-05-1120", "219-09-9999", "457-55-5462", "123-45-6789", "111-11-1111", "987-65-4321")
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
AREA_CODES = r"^\(?[2-9](?!11|9)[0-9]{2}"
SECRET_PREFIXES = r"^(AKIA|ASIA|AIza|ghp_|gho_|ghs_|glpat-|sk-|sk_live_|xox[abp]-|eyJ)"
STREET_WORDS = r"(Street|Road|Avenue|Lane|Drive|Boulevard|straße|strasse|gasse|platz|rue|avenue|boulevard|Calle|Avenida|Plaza)"
FAMILY_NAMES = r"\x20(Smith|Johnson|Williams|Brown|Jones|Miller|Davis|Wilson|Taylor|Müller|Schmidt|Schneider|Fischer|Weber|Meyer|Martin|Bernard|Dubois|Durand|Moreau|García|Garcia|Fernández|González|Rodríguez|López|Martínez|Pérez)\b"
# Fixed values of the context labeler: words before a span that speak for and against its kind.
FOR = {
    "email": r"mail|contact|write to|kontakt|correo|courriel|@",
    "ip": r"\bip\b|host|server|address|client|adresse",
    "card": r"card|visa|mastercard|karte|tarjeta|carte|payment",
    "phone": r"phone|\btel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone",
    "ssn": r"ssn|social security",
    "iban": r"iban|account|konto|cuenta|compte",
    "masked_email": r"mail|contact|write to",
    "local_phone": r"phone|\btel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone",
    "secret": r"token|key|secret|passw|auth|bearer|credential",
    "address": r"address|live|resid|adresse|wohn|anschrift|dirección|domicili|habite",
    "person": r"name|\b(mr|mrs|ms|dr|by|dear|herr|frau|monsieur|madame|señor|señora)\b",
}
AGAINST = r"version|release|section|isbn|issn|\bid\b|order no|invoice|figure|table|doi|commit|checksum|md5|sha|digest"
#: Labelers in the order of their votes.
LABELERS = ("format", "gazetteer", "context")
#: A span that is no base span is kept from this probability on.
ACCEPT = 0.5
#: Code points of context before a span; a text is cut into pieces of PIECE code points, so that any of its places is found without reading on from its start.
CONTEXT, PIECE = 40, 64
#: Matches whose places are added up one by one.
TOGETHER = 64
#: Values of the hashed word before a span.
WORDS = 64
#: Features of ``shapes``.
FEATURES = 5


SPAN = "array<struct<kind:string,start:bigint,end:bigint,match:string>>"
JUDGED = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,votes:array<int>,shape:array<int>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often lambdas within ``body`` read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def located(kind: str, text: Column, matches: Column) -> Column:
    """Spans of all matches: the pieces between them tell how far along each begins (in code points).

    Places are added up within groups of TOGETHER matches and over the groups, so a text with very many
    matches takes little more than time in proportion.
    """
    steps = F.arrays_zip(F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))
    groups = let(steps, lambda all_: F.transform(F.sequence(F.lit(1), F.size(all_), F.lit(TOGETHER)), lambda first: F.slice(all_, first, F.lit(TOGETHER))))
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,match:string>>").alias("found"))

    def step(held: Column, x: Column) -> Column:
        begin = held["at"] + F.length(x["gap"])
        return F.struct((begin + F.length(x["match"])).cast("bigint").alias("at"), F.concat(held["found"], F.array(F.struct(begin.cast("bigint").alias("start"), x["match"].alias("match")))).alias("found"))

    def placed(found: Column) -> Column:
        before = F.aggregate(found, F.array(F.lit(0).cast("bigint")), lambda held, g: F.concat(held, F.array(F.element_at(held, -1) + g["at"])))
        return let(before, lambda base: F.flatten(F.transform(found, lambda g, i: F.transform(g["found"], lambda x: F.struct(F.lit(kind).alias("kind"), (F.get(base, i) + x["start"]).alias("start"), (F.get(base, i) + x["start"] + F.length(x["match"])).alias("end"), x["match"].alias("match"))))))

    return let(F.transform(groups, lambda g: F.aggregate(g, none, step)), placed)


def context(pieces: Column, start: Column) -> Column:
    """The CONTEXT code points before a place, in lower case; ``pieces`` are the text's."""
    at = F.floor(start / PIECE).cast("int")
    part = F.concat(F.when(at > 0, F.get(pieces, at - 1)).otherwise(F.lit("")), F.substring(F.coalesce(F.get(pieces, at), F.lit("")), F.lit(1), (start % PIECE).cast("int")))
    return F.lower(F.right(part, F.lit(CONTEXT)))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(number))
    value = lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    return F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i))) % 10 == 0


def by_kind(span: Column, of: dict[str, Column], otherwise: Column) -> Column:
    found = otherwise
    for kind, value in of.items():
        found = F.when(span["kind"] == kind, value).otherwise(found)
    return found


def mod_97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes its check: letters count from 10, the first four characters come last."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    code = lambda text, i: F.ascii(F.substring(text, i, F.lit(1)))
    value = lambda held, c: F.when(c >= 65, held * 100 + c - 55).otherwise(held * 10 + c - 48) % 97
    return let(turned, lambda text: F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), lambda held, i: value(held, code(text, i)))) == 1


def format_passes(span: Column) -> Column:
    match = span["match"]
    number = digits(match)
    compact = F.replace(match, F.lit(" "), F.lit(""))
    part = lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0")).cast("int") <= 255).otherwise(False)
    return by_kind(
        span,
        {
            "ip": F.forall(F.split(match, r"\."), part),
            "card": F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False),
            "phone": F.length(number).between(9, 15),
            "ssn": ~match.rlike(r"^(000|666|9[0-9][0-9])|-00-|-0000$"),
            "iban": F.when(F.length(compact).between(15, 34), mod_97(compact)).otherwise(False),
            "masked_email": ~match.rlike(r"\.\.|^[.-]|-\x20?[\[(.]|[.\])]\x20?-"),
            "local_phone": match.rlike(r"^(\(...\)\x20?|...([\x20.-]))...\2?[\x20.-]?....$") & ~match.rlike(r"^...[.-]...\x20|^...\x20...\."),
            "secret": ((F.length(digits(match)) * 8 >= F.length(match)) & match.rlike("[A-Za-z]")) | match.rlike(SECRET_PREFIXES),
            "address": ~match.rlike(r"(^|\x20)0|[0-9]{5}"),
            "person": ~match.rlike(r"\x20(\p{Lu}{2,}|\p{L}{1,2})$"),
                        },
        F.lit(True),
    )


def votes(span: Column) -> list[Column]:
    """1, -1 or 0 (none) of each labeler."""
    match, before = span["match"], span["before"]
    sign = lambda c: F.when(c, 1).otherwise(-1)
    ending = F.lower(F.element_at(F.split(match, r"\.|[\])]\x20?"), -1))
    compact = F.replace(match, F.lit(" "), F.lit(""))
    expected = lookup({k: float(n) for k, n in IBAN_LENGTHS.items()}, F.substring(match, 1, 2))
    known = by_kind(
        span,
        {
            "email": sign(ending.isin(*ENDINGS)),
            "masked_email": sign(ending.isin(*ENDINGS)),
            "ip": sign(~match.rlike(RESERVED_RANGES)),
            "card": sign(digits(match).rlike(ISSUERS)),
                    "phone": sign(match.rlike(CALLING_CODES)),
                    "ssn": F.when(match.isin(*SAMPLE_SSNS), -1).when(match < "773", 1).otherwise(0),
            "iban": F.when(expected == 0, 0).otherwise(sign(expected == F.length(compact))),
            "local_phone": sign(match.rlike(AREA_CODES)),
            "secret": F.when(match.rlike(SECRET_PREFIXES), 1).when(match.rlike("[/+].*[/+]|^[0-9]+$"), -1).otherwise(0),
            "address": F.when(match.rlike(STREET_WORDS), 1).otherwise(0),
            "person": F.when(match.rlike(FAMILY_NAMES), 1).otherwise(0),
        },
        F.lit(0),
    )
    speaks = by_kind(span, {k: before.rlike(p) for k, p in FOR.items()}, F.lit(False))
    return [sign(format_passes(span)), known, F.when(speaks, 1).when(before.rlike(AGAINST), -1).otherwise(0)]


def shapes(span: Column) -> list[Column]:
    """Features of the final classifier, each with a few values: length, digits, separators, what stands before, the word before (hashed)."""
    match, before, n = span["match"], span["before"], F.length(span["match"])
    return [
        F.least(n / 4, F.lit(9)).cast("int"),
        F.least(F.length(digits(match)) / 3, F.lit(7)).cast("int"),
        F.when(match.rlike(r"[\x20]"), 1).otherwise(0) + F.when(match.rlike("-"), 2).otherwise(0) + F.when(match.rlike(r"\."), 4).otherwise(0) + F.when(match.rlike(r"[()\[\]]"), 8).otherwise(0),
        F.when(before == "", 0).when(before.rlike(r"\s$"), 1).when(before.rlike(r"[\p{L}\p{N}]$"), 2).otherwise(3),
        F.pmod(F.xxhash64(F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*+$", 1)), F.lit(WORDS)).cast("int"),
    ]


def pattern(votes: Column) -> Column:
    """The labelers' votes as one more feature: what they agree on speaks in the final decision, too."""
    return reduce(lambda a, j: 3 * a + F.element_at(votes, j + 1) + 1, range(len(LABELERS)), F.lit(0)).cast("int")


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id and its proposed spans: kind, start, end, base, votes and shape. A null text has none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = documents.select("doc_id", text.alias("text"))
    none = F.array().cast("array<string>")
    tried = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    found = found.select("doc_id", "text", *(F.when(reduce(or_, (F.contains(F.col("text"), F.lit(mark)) for mark in MARKS[k])), m).otherwise(none).alias(k) if k in MARKS else m.alias(k) for k, m in tried.items()))
    spans = F.concat(*(F.when(F.size(k) > 0, located(k, F.col("text"), F.col(k))).otherwise(F.array().cast(SPAN)) for k in KINDS))
    cut = F.regexp_extract_all("text", F.lit(f"[\\s\\S]{{1,{PIECE}}}"), F.lit(0))

    def judged(x: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (x["kind"].isin(*BASE) & format_passes(x)).alias("base"), F.array(*votes(x)).alias("votes"), F.array(*shapes(x)).alias("shape"))

    def with_context(pieces: Column) -> Column:
        seen = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), context(pieces, x["start"]).alias("before"))
        return F.transform(F.transform("found", seen), judged)

    found = found.select("doc_id", "text", spans.alias("found"))
    judged_spans = F.when(F.size("found") > 0, let(cut, with_context)).otherwise(F.array().cast(JUDGED))
    return found.select("doc_id", judged_spans.alias("spans"))


def reliabilities(counts: list[tuple[str, tuple, int]], rounds: int = 50) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count): P(real | kind, votes), and P(vote | labeler, kind, real).

    Labelers are taken as independent given the truth. The first posteriors are the majority's; counts
    are smoothed so that no probability is 0. The patterns number 3**3 per kind at most, however large the corpus.
    """
    posterior = {(k, v): 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for k, v, _ in counts}
    rates: dict = {}
    for _ in range(rounds):
        seen: dict = defaultdict(lambda: 0.1)
        real: dict = defaultdict(float)
        for kind, vote, n in counts:
            p = posterior[kind, vote]
            for truth, weight in ((1, n * p), (0, n * (1 - p))):
                real[kind, truth] += weight
                for j, v in enumerate(vote):
                    seen[j, kind, truth, v] += weight
        rates = {(j, kind, truth, v): (seen[j, kind, truth, v] + (2.0 if (v > 0) == (truth == 1) and v else 0.5)) / (real[kind, truth] + 3.3) for kind, vote, _ in counts for j in range(len(vote)) for truth in (0, 1) for v in (-1, 0, 1)}
        for kind, vote, _ in counts:
            odds = math.log(real[kind, 1] + 1) - math.log(real[kind, 0] + 1)
            odds += sum(math.log(rates[j, kind, 1, v] / rates[j, kind, 0, v]) for j, v in enumerate(vote))
            posterior[kind, vote] = 1 / (1 + math.exp(-max(min(odds, 35.0), -35.0)))
    return posterior, rates


def classifier(rows: list[tuple[str, tuple, int, int, int]], posterior: dict) -> tuple[dict[str, float], dict[tuple[str, int], dict[int, float]]]:
    """Log odds by kind, and by kind and feature for each value, from (kind, votes, feature, value, count) weighted by posteriors (naive Bayes)."""
    kinds: dict = defaultdict(lambda: [1.0, 1.0])
    values: dict = defaultdict(lambda: defaultdict(lambda: [0.5, 0.5]))
    for kind, vote, j, v, n in rows:
        p = posterior[kind, vote]
        for held in [kinds[kind]] * (j == 0) + [values[kind, j][v]]:
            held[0] += n * (1 - p)
            held[1] += n * p
    prior = {k: math.log(b / a) for k, (a, b) in kinds.items()}
    return prior, {of: {v: math.log(b / kinds[of[0]][1]) - math.log(a / kinds[of[0]][0]) for v, (a, b) in found.items()} for of, found in values.items()}


def lookup(weights: dict, key: Column) -> Column:
    if not weights:
        return F.lit(0.0)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for item in sorted(weights.items()) for x in item)), key), F.lit(0.0))


def personal_data(documents: DataFrame, rounds: int = 50) -> DataFrame:
    """doc_id and spans (kind, start, end, base, p) of every document, by start and then kind as listed.

    Starts and ends count code points, ends exclusive. Base spans stay; a span of another kind is kept if
    the final classifier, trained on the posteriors of ``rounds`` rounds of EM, gives it ACCEPT or more. A
    null or empty text has no spans; rows that repeat a doc_id each give a row; other columns are ignored;
    an empty table gives an empty table. Of the candidates only counts of kind, votes and one feature's value
    reach the driver: their number is bounded by the labelers' values and the features' buckets, not by
    the corpus.
    """
    proposed = written(candidates(documents), "pii")
    span = proposed.select(F.explode("spans").alias("span"))
    features = span.select("span.kind", "span.votes", F.posexplode(F.concat("span.shape", F.array(pattern(F.col("span.votes"))))).alias("feature", "value"))
    rows = [(r["kind"], tuple(r["votes"]), r["feature"], r["value"], r["count"]) for r in features.groupBy("kind", "votes", "feature", "value").count().collect()]
    by_votes: dict = defaultdict(int)
    for kind, vote, j, _, n in rows:
        by_votes[kind, vote] += n * (j == 0)
    posterior, _ = reliabilities(sorted((k, v, n) for (k, v), n in by_votes.items()), rounds)
    prior, weights = classifier(sorted(rows), posterior)

    def scored(span: Column) -> Column:
        odds = by_kind(span, {k: reduce(add, (lookup(weights.get((k, j), {}), F.element_at(span["shape"], j + 1) if j < FEATURES else pattern(span["votes"])) for j in range(FEATURES + 1)), F.lit(known)) for k, known in prior.items()}, F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(35.0)), F.lit(-35.0))))
        order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), span["kind"])
        return F.struct(span["start"].alias("start"), order.alias("order"), span["kind"].alias("kind"), span["end"].alias("end"), span["base"].alias("base"), p.alias("p"))

    kept = F.filter(F.transform("spans", scored), lambda s: s["base"] | ((s["p"] >= ACCEPT) & ~s["kind"].isin(*BASE)))
    return proposed.select("doc_id", F.array_sort(kept).alias("spans"))


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

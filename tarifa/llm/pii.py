"""Personal data by weak supervision. DataFrame functions only.

Patterns propose candidate spans; four labelers vote on each: a check (ranges, Luhn, length, IBAN remainder, dates), a gazetteer of cue words
in the span, a gazetteer of cue words before it, and the span's shape. For each kind, expectation-maximisation estimates from how often
each combination of votes occurs in all documents how far each labeler is right; what a check says is known, not estimated. Its posteriors
train the final span classifier, naive Bayes over votes, kind, length and neighbouring characters. Spans that pass the check of a base kind
are always kept; the classifier decides on all others, base candidates that fail their check among them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.llm.shared import stored

#: kind -> pattern, as the contract has it, with runs that never need to give back a character made possessive and with starts
#: that only the beginning of a run, or the end of the match before, can have.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates, which only the classifier can accept.
FURTHER = {
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "birth": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++){0,2}",
    "address": r"(?<![0-9])[0-9]{1,5}\x20(?:[A-Z][a-z]+\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Square)(?![A-Za-z])",
}
#: A text without a match of this has no candidates of the kind.
NEEDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9_+/=-]{20}", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]",
    "birth": r"[0-9][./-][0-9]{1,2}[./-][0-9]", "name": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z]", "address": r"[0-9]\x20[A-Z][a-z]",
}
KINDS = [*BASE, *FURTHER]
#: How spans are called: kinds, and base candidates that failed their check but were accepted.
NAMES = [*KINDS, *(f"likely_{kind}" for kind in BASE)]
#: Kinds with a check of their own.
CHECKED = (*BASE, "iban", "ssn", "birth")
CUES_BEFORE = {
    "email": r"(?i)(?:e-?mail|mail|contact|write to|reach)", "ip": r"(?i)(?:\bip\b|address|host|server|login)", "card": r"(?i)(?:card|visa|mastercard|amex|payment|credit)",
    "phone": r"(?i)(?:phone|call|tel\b|mobile|fax|contact)", "secret": r"(?i)(?:token|secret|passw|api.?key|access.?key|private.?key|credential)",
    "iban": r"(?i)(?:iban|account|bank|transfer|konto)", "ssn": r"(?i)(?:ssn|social|security|tax)", "birth": r"(?i)(?:born|birth|\bdob\b|geboren|nacid)", "name": r"(?i)(?:name|dear|signed|patient|customer|contact)",
    "address": r"(?i)(?:address|lives? at|ship|home|residence|located)",
}
CUES_INSIDE = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|co|de|fr|es|uk)$", "ip": r"^(?:10|127|172|192)\.", "card": r"^(?:4|5[1-5]|3[47]|6011)", "phone": r"^\+(?:1|33|34|44|49)\b", "secret": r"^(?:sk-|ghp_|AKIA|xox)",
    "iban": "^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|NL|NO|PL|PT|SE)", "ssn": "^[0-8]", "birth": r"(?:^|[./])(?:19|20)[0-9]{2}", "name": r"^(?:Mr|Mrs|Ms|Dr|Prof)\.", "address": "(?:Street|Avenue|Road|Lane|Drive|Boulevard|Square)$",
}
#: Characters before a span that the context labeler reads.
CONTEXT = 32
#: Accept a further span from this probability on; rounds of expectation-maximisation.
ACCEPT, ROUNDS = 0.9, 50
#: P(vote | personal) and P(vote | not) before anything is estimated, and of a check.
START, CHECK = {"+": (0.7, 0.2), "-": (0.1, 0.4), "0": (0.2, 0.4)}, {"+": (0.97, 0.1), "-": (0.02, 0.8), "0": (0.01, 0.1)}
_CANDIDATE = "struct<kind:int,pos:int,gap:bigint,size:bigint,valid:boolean,feature:string,votes:string>"


def _checks(kind: str, hit: Column) -> Column:
    """The base check of a match."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        padded = F.lpad(digits, 20, "0")
        doubled = F.translate(F.concat(*(F.substring(padded, i, 1) for i in range(1, 20, 2))), "123456789", "246813579")
        kept = F.concat(*(F.substring(padded, i, 1) for i in range(2, 21, 2)))
        total = F.aggregate(F.split(F.concat(doubled, kept), ""), F.lit(0), lambda a, x: a + F.coalesce(x.try_cast("int"), F.lit(0)))
        return F.length(digits).between(13, 19) & (total % 10 == 0)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.replace(hit, F.lit(" "), F.lit(""))
        turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
        value = lambda c: F.coalesce(c.try_cast("int"), F.ascii(c) - 55)
        rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97)
        return F.length(plain).between(15, 34) & (rest == 1)
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "birth":
        year_first = r"^(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$"
        return hit.rlike(year_first) | hit.rlike(r"^(?:0?[1-9]|[12][0-9]|3[01])[./](?:0?[1-9]|[12][0-9]|3[01])[./](?:19|20)[0-9]{2}$")
    return F.lit(kind in BASE)


def _shape(kind: str, hit: Column) -> Column:
    """The shape labeler: '+' for, '-' against, '0' no opinion."""
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    if kind == "email":
        return F.when(F.length(hit) <= 64, "+").otherwise("-")
    if kind == "ip":
        return F.when(F.length(hit) <= 15, "+").otherwise("-")
    if kind == "card":
        return F.when(digits.between(15, 16), "+").when(digits < 13, "-").otherwise("0")
    if kind == "phone":
        return F.when(digits.between(10, 13), "+").when(digits < 9, "-").otherwise("0")
    if kind == "iban":
        return F.when(F.length(hit) >= 18, "+").otherwise("0")
    if kind in ("ssn", "birth", "name", "address"):
        return F.when(F.length(hit) <= 48, "+").otherwise("-")
    mixed = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.when(mixed & (digits * 5 >= F.length(hit)), "+").when(~mixed, "-").otherwise("0")


def _of_kind(number: int, kind: str, text: Column) -> Column:
    """All candidates of a kind in a text, leftmost first, as _CANDIDATE structs: how far each begins after the one before ends, and its size."""
    pattern = (BASE | FURTHER)[kind]
    whole = rf"(?s)\G(.*?)({pattern})"  # what lies between matches, and the matches
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(whole), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(whole), F.lit(2)).alias("hit"))

    def candidate(x: Column, at: Column) -> Column:
        hit, before = x["hit"], F.right(x["gap"], F.lit(CONTEXT))
        valid = _checks(kind, hit)
        check = F.when(valid, "+").otherwise("-") if kind in CHECKED else F.lit("0")
        inside = F.when(hit.rlike(CUES_INSIDE[kind]), "+").otherwise("0")
        cue = F.when(before.rlike(CUES_BEFORE[kind]), "+").otherwise("0")
        votes = F.concat(check, inside, cue, _shape(kind, hit))
        length = F.least(F.lit(7), F.floor(F.log2(F.length(hit)))).cast("string")
        left = F.when(before.rlike(r"[\"'=:]\s*$"), "q").when(before.rlike(r"\s$|^$"), "s").otherwise("o")
        feature = F.concat(F.lit(f"{number}"), length, left, votes)
        return F.struct(F.lit(number).alias("kind"), at.alias("pos"), F.length(x["gap"]).cast("long").alias("gap"), F.length(hit).cast("long").alias("size"), valid.alias("valid"), feature.alias("feature"), votes.alias("votes"))

    none = F.array().cast(f"array<{_CANDIDATE}>")
    return F.when(text.rlike(NEEDS[kind]), F.transform(pairs, candidate)).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id and all candidate spans of every row of docs."""
    text = F.coalesce("text", F.lit(""))
    spans = F.concat(*(_of_kind(n, kind, text).cast(f"array<{_CANDIDATE}>") for n, kind in enumerate(KINDS)))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", spans.alias("spans"))


def reliabilities(patterns: dict[str, int], rounds: int = ROUNDS, known: dict[int, dict] | None = None) -> tuple[float, list[dict[str, tuple[float, float]]]]:
    """Prior, and for each labeler P(vote | personal) and P(vote | not), from counts of vote combinations; `known` ones stay as they are."""
    n = max((len(p) for p in patterns), default=0)
    known = known or {}
    prior = 0.5
    tables = [known.get(i, START) for i in range(n)]
    for _ in range(rounds):
        mass = [[{v: 1.0 for v in "+-0"} for _ in range(2)] for _ in range(n)]
        total = [1.0, 1.0]
        for votes, count in patterns.items():
            p = posterior(votes, prior, tables)
            for side, share in ((0, p), (1, 1 - p)):
                total[side] += count * share
                for labeler, vote in enumerate(votes):
                    mass[labeler][side][vote] += count * share
        prior = total[0] / sum(total)
        tables = [known.get(i) or {v: (m[0][v] / sum(m[0].values()), m[1][v] / sum(m[1].values())) for v in "+-0"} for i, m in enumerate(mass)]
    return prior, tables


def posterior(votes: str, prior: float, tables: list[dict[str, tuple[float, float]]]) -> float:
    odds = math.log(prior / (1 - prior))
    for labeler, vote in enumerate(votes):
        yes, no = tables[labeler][vote]
        odds += math.log(yes / no)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def classifier(features: dict[str, int], prior: float, tables: list[dict[str, tuple[float, float]]]) -> dict[str, float]:
    """The probability of each feature combination: naive Bayes over its characters, trained on the posteriors."""
    places = max((len(f) for f in features), default=0)
    counts: list[dict[str, list[float]]] = [{} for _ in range(places)]
    total = [1.0, 1.0]
    for feature, count in features.items():
        p = posterior(feature[-len(tables) :], prior, tables)
        for side, share in ((0, p), (1, 1 - p)):
            total[side] += count * share
            for place, value in enumerate(feature):
                counts[place].setdefault(value, [0.5, 0.5])[side] += count * share
    out = {}
    for feature in features:
        odds = math.log(total[0] / total[1])
        for place, value in enumerate(feature):
            yes, no = counts[place][value]
            odds += math.log((yes / total[0]) / (no / total[1]))
        out[feature] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return out


def accepted_features(counts: list[tuple[int, str, str, int]], accept: float = ACCEPT) -> list[str]:
    """Features that the classifier accepts, from counts (kind, feature, votes, count): for each kind the labelers' reliabilities, then the classifier."""
    out = []
    for number, kind in enumerate(KINDS):
        own = [(feature, votes, n) for k, feature, votes, n in counts if k == number]
        patterns: dict[str, int] = {}
        for _, votes, n in own:
            patterns[votes] = patterns.get(votes, 0) + n
        prior, tables = reliabilities(patterns, known={0: CHECK} if kind in CHECKED else None)
        chances = classifier({feature: n for feature, _, n in own}, prior, tables)
        out += [feature for feature, p in sorted(chances.items()) if p >= accept]
    return out


def find_personal(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans for every row of docs (doc_id, text).

    spans has kind:start:end of every span, by kind (as NAMES has them) and start, in code points, end exclusive. A span of the classifier's
    that touches a base span is dropped. Null and empty texts have none. A very long text is searched whole, in time that grows with it.
    Repeated rows get the same spans; a null doc_id stays null; an empty table gives an empty result; extra columns are not read. What is
    gathered on the driver are counts of feature combinations, of which there are a few thousand at most.
    """
    rows = stored(candidates(docs), "pii-candidates")  # row is fixed from here on
    spans = rows.select("row", F.inline("spans"))
    accepted = accepted_features([tuple(r) for r in spans.groupBy("kind", "feature", "votes").count().collect()], accept)
    in_kind = Window.partitionBy("row", "kind").orderBy("pos")
    stop = F.sum(F.col("gap") + F.col("size")).over(in_kind)
    base = (F.col("kind") < len(BASE)) & F.col("valid")
    placed = spans.repartition("row").select("row", "kind", base.alias("base"), (base | F.col("feature").isin(accepted)).alias("kept"), (stop - F.col("size")).alias("start"), stop.alias("stop")).where("kept")
    forth, back = Window.partitionBy("row").orderBy("start", F.desc("base"), "kind"), Window.partitionBy("row").orderBy(F.desc("start"), "base", F.desc("kind"))
    before = F.max(F.when(F.col("base"), F.col("stop"))).over(forth.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))  # a frame that grows: one pass
    placed = placed.select("*", before.alias("before"), after.alias("after")).where("base OR (coalesce(before <= start, true) AND coalesce(after >= stop, true))")
    named = F.when(F.col("base") | (F.col("kind") >= len(BASE)), F.col("kind")).otherwise(F.col("kind") + len(KINDS))
    by_row = placed.groupBy("row").agg(
        *(F.count_if(F.col("base") & (F.col("kind") == n)).alias(f"n_{kind}") for n, kind in enumerate(BASE)),
        F.array_sort(F.collect_list(F.struct(named.alias("kind"), "start", "stop", "base"))).alias("found"),
    )
    names = F.array(*map(F.lit, NAMES))
    joined = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    all_ = rows.select("row", "doc_id").join(by_row, "row", "left")
    own = F.coalesce("found", F.array().cast("array<struct<kind:int,start:bigint,stop:bigint,base:boolean>>"))
    return all_.select(
        "doc_id", *(F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(F.filter(own, lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), joined(own).alias("spans"), F.size(own).cast("long").alias("n_spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))

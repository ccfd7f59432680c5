"""Personal data by weak supervision [native].

1. Candidates. Fixed patterns give the base spans of four kinds (e-mail
   addresses, IP addresses, card numbers, telephone numbers). Looser ones give
   what may be more: addresses written out ("x (at) y (dot) org"), IPv6, numbers
   with the form of a card but a wrong check digit, national telephone numbers.
2. Five labelers vote on each candidate, for, against or not at all: the shape
   (regex), gazetteers (top-level domains, calling codes, card issuers), words
   around it (context), the characters at its edges, and its layout.
3. Expectation-maximisation estimates, for each kind, how reliable each labeler
   is and how likely each pattern of votes is to be right. It needs only how
   often each pattern occurs: at most 3**5 counts a kind, summed before the
   shuffle.
4. A naive Bayes classifier is trained on these probabilities, over votes and
   hashed features of a span and its neighbourhood; its sums are one aggregate of
   BUCKETS rows a kind. A candidate at or above LEAST_PROBABILITY, with more
   votes for than against it, is a span. Base spans stay whatever their score.

Texts are read once, row by row, with DataFrame functions; candidates are kept
by document in a table in the shared folder, without texts, so no key, source or
group of copies gathers in a task.

Positions come from what lies between matches: a text is split by the pattern,
and the sizes of gaps and matches are summed up in blocks. Patterns repeat
groups possessively, which Java does in a loop, not by recursion.

Defined results: a null or empty text has no spans; rows that repeat give
repeated results; a null doc_id is kept as it is; very long texts are read
whole; spans that tie in their start go by kind; an empty table gives no rows;
other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, id_text

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20(?=[A-Za-z0-9-]{1,63}\x20dot\x20))[A-Za-z0-9-]{1,63}(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.])[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+#=/]|[0-9][\x20.-]|\+[0-9]{1,3}[\x20.-]\(?|\()(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[\x20.-][0-9])|(?<![0-9A-Za-z+])00[1-9][0-9]{0,2}[\x20.-][0-9](?:[\x20.-]?[0-9]){6,11}+(?![0-9A-Za-z]|[\x20.-][0-9])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
LOOSE_NEEDS = {"email": r"(?:[(\[]at[)\]]| at )[^\n]{1,70}(?:dot|\.)", "ip": r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"}
# Gazetteers and words of the context, by kind.
DOMAINS = "com org net edu gov mil int info biz name io co ai app dev de fr es it uk us ca eu ch at nl be pl se no fi dk cz pt ru ua cn jp kr in au nz br mx ar cl za tr gr ie hu ro".split()
CALLING_CODES = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[0578]|9[679])[0-9])"
ISSUERS = r"^(?:4|5[0-9]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|30[0-5]|3[689]|35(?:2[89]|[3-8])|6(?:011|2|3|4[4-9]|5|7))"
CONTEXT = {
    "email": "mail|e-mail|email|contact|write|reply|correo|courriel|adresse|kontakt",
    "ip": "ip|ipv6|host|server|address|addr|client|login|gateway|adresse|dirección",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|kreditkarte|carte|tarjeta",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|telefon|handy|rufen|téléphone|appelez|teléfono|llame|móvil",
}
OTHER_CONTEXT = "version|release|order|invoice|isbn|issn|serial|part|page|section|sku|token|hash|sha|key|tracking|article|bestellung|rechnung|commande|facture|pedido|factura"
LABELERS = ("shape", "gazetteer", "context", "edges", "layout")
BEFORE, AFTER = 40, 20
BLOCK = 256
BUCKETS = 512
LEAST_PROBABILITY = 0.9
ROUNDS, PRIOR = 50, 20.0
#: Share of votes against, none and for that a labeler is taken to give before anything is seen, for wrong and for right candidates.
TRUST = ((0.5, 0.35, 0.15), (0.15, 0.35, 0.5))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def running(sizes: Column) -> Column:
    """For each size the sum of those before it; blocks of BLOCK keep the work near linear."""
    empty = F.array().cast("array<int>")

    def sums(values: Column) -> Column:
        step = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.aggregate(values, step, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda k: F.slice(sizes, k * BLOCK + 1, F.lit(BLOCK)))
    begun = F.zip_with(blocks, sums(F.transform(blocks, total)), lambda values, at: F.transform(sums(values), lambda x: x + at))
    return F.when(F.size(sizes) > 0, F.flatten(begun)).otherwise(empty)


def matches(name: str, pattern: str, hits: Column, text: Column) -> Column:
    """Structs of start, what, before and after of all hits of a pattern in a text."""
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(hits, gaps, lambda h, g: F.coalesce(F.length(h), F.lit(0)) + F.length(g))
    pieces = F.struct(hits.alias("hits"), gaps.alias("gaps"), running(sizes).alias("at"))

    def one(p: Column, i: Column) -> Column:
        gap, behind = F.get(p["gaps"], i), F.get(p["gaps"], i + 1)
        return F.struct((F.get(p["at"], i) + F.length(gap)).alias("start"), F.get(p["hits"], i).alias("what"), F.substring(gap, -BEFORE, BEFORE).alias("before"), F.substring(behind, 1, AFTER).alias("after"))

    # a one-element array binds the pieces to a name, so that a text is split once
    found = F.flatten(F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(0), F.size(p["hits"]) - 1), lambda i: one(p, i))))
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast("array<struct<start:int,what:string,before:string,after:string>>"))


def digits(what: Column) -> Column:
    return F.regexp_replace(what, "[^0-9]", "")


def valid(kind: str, what: Column) -> Column:
    """Whether a hit of a base pattern is a base span."""
    if kind == "ip":
        return F.forall(F.split(what, r"\."), lambda p: F.coalesce(F.ltrim(p, F.lit("0")).rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"), F.lit(False)))
    if kind == "card":
        return F.length(digits(what)).between(12, 19) & F.call_function("luhn_check", digits(what))
    if kind == "phone":
        return F.length(digits(what)).between(9, 15)
    return F.lit(True)


def vote(right: Column, wrong: Column) -> Column:
    return F.when(right & ~wrong, 1).when(wrong & ~right, -1).otherwise(0)


def votes(kind: str, base: Column, failed: Column, c: Column) -> list[Column]:
    """One vote of each labeler on a candidate."""
    what, before, after = c["what"], c["before"], c["after"]
    figures = digits(what)
    near = rf"(?i)(?<!\p{{L}})(?:{CONTEXT[kind]})(?!\p{{L}})"
    far = rf"(?i)(?<!\p{{L}})(?:{OTHER_CONTEXT})(?!\p{{L}})|(?i)(?<!\p{{L}})v\.?$"
    edge = r"[\p{L}\p{N}_=#/@\\]"
    if kind == "email":
        last = F.lower(F.regexp_extract(what, r"([A-Za-z0-9-]+)$", 1))
        known, unknown = last.isin(*DOMAINS), ~last.rlike("^[a-z]{2,18}$")
        good, bad = what.rlike(r"^[A-Za-z0-9_+-]"), what.rlike(r"^[.%-]|\.\.|\.@|^[^@]{65}")
    elif kind == "ip":
        known, unknown = what.rlike(r"^(?:[1-9]|1[0-9]{2}|[2-9][0-9]|2[0-4][0-9]|25[0-5])\."), what.rlike(r"^0+\.|^2[4-5][0-9]\.")
        good, bad = ~what.rlike(r"(?:^|\.)0[0-9]"), what.rlike(r"(?:^|\.)0[0-9]|^[0-9](?:\.[0-9]){3}$")
    elif kind == "card":
        known, unknown = figures.rlike(ISSUERS) & F.length(figures).between(13, 19), ~figures.rlike(ISSUERS)
        good, bad = what.rlike(r"^(?:[0-9]{4}([\x20./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}|[0-9]{13,16})$"), what.rlike(r"^([0-9])\1+$|^(?:[0-9]{1,3}[\x20-]){4}")
    else:
        national = ~what.rlike(r"^(?:\+|00)")
        known = what.rlike(rf"^(?:\+|00){CALLING_CODES}") | national & figures.rlike(r"^[2-9][0-9]{2}[2-9]")
        unknown = ~known
        good, bad = what.rlike(r"[\x20(.-][0-9]{2,4}[\x20.-][0-9]{2,4}[\x20.-]?[0-9]*$"), figures.rlike(r"([0-9])\1{6}")
    return [
        vote(base, failed),
        vote(known, unknown),
        vote(before.rlike(near), before.rlike(far)),
        vote(~before.rlike(edge + "$") & ~after.rlike("^" + edge), before.rlike(edge + "$") | after.rlike("^" + edge)),
        vote(good, bad),
    ]


def features(k: int, pattern: Column, c: Column) -> Column:
    """Places in the weights: the pattern of votes, the form of the span, and words and characters around it."""
    shape = F.regexp_replace(F.regexp_replace(c["what"], "[0-9]", "9"), r"\p{L}+", "a")
    words = F.split(F.lower(c["before"]), r"[^\p{L}]+")
    following = F.regexp_extract(F.lower(c["after"]), r"^[^\p{L}]*(\p{L}+)", 1)
    named = {
        "votes": pattern.cast("string"),
        "shape": F.substring(shape, 1, 40),
        "size": F.length(c["what"]).cast("string"),
        "word": F.get(F.filter(words, lambda w: w != ""), F.size(F.filter(words, lambda w: w != "")) - 1),
        "next": following,
        "edges": F.concat(F.substring(c["before"], -1, 1), F.lit("|"), F.substring(c["after"], 1, 1)),
    }
    return F.array(*((F.pmod(F.xxhash64(F.lit(n), F.coalesce(v, F.lit(""))), F.lit(BUCKETS)).cast("int") + k * BUCKETS) for n, v in named.items()))


SPAN = "struct<start:int,kind:int,end:int,base:boolean,votes:int,features:array<int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: start, kind, end, whether it is a base span, its votes (base 3) and features; one row per input row."""
    told = id_text(docs)
    text = F.col("text")
    none = F.array().cast("array<string>")
    hits = {}
    for kind in KINDS:
        found = F.regexp_extract_all(text, F.lit(BASE[kind]), 0)
        hits[f"{kind}_hits"] = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(none) if kind in NEEDS else found
        loose = F.regexp_extract_all(text, F.lit(LOOSE[kind]), 0)
        hits[f"{kind}_loose"] = F.when(text.rlike(LOOSE_NEEDS[kind]), loose).otherwise(none) if kind in LOOSE_NEEDS else loose
    told = told.select("doc_id", "text", *(h.alias(n) for n, h in hits.items()))
    told = told.select("doc_id", *(matches(n, (BASE if n.endswith("_hits") else LOOSE)[n.split("_")[0]], F.col(n), text).alias(n) for n in hits))

    def spans(k: int, kind: str, loose: bool) -> Column:
        def one(c: Column) -> Column:
            base = F.lit(False) if loose else valid(kind, c["what"])
            failed = F.lit(False) if loose else ~base
            pattern = F.lit(0)
            for v in votes(kind, base, failed, c):
                pattern = pattern * 3 + v + 1
            return F.struct(c["start"].alias("start"), F.lit(k).alias("kind"), (c["start"] + F.length(c["what"])).alias("end"), base.alias("base"), pattern.cast("int").alias("votes"), features(k, pattern, c).alias("features")).cast(SPAN)

        return F.transform(F.col(f"{kind}_{'loose' if loose else 'hits'}"), one)

    base = F.concat(*(spans(k, kind, False) for k, kind in enumerate(KINDS)))
    loose = F.concat(*(spans(k, kind, True) for k, kind in enumerate(KINDS)))
    told = told.select("doc_id", base.alias("base"), loose.alias("loose"))
    sure = F.filter("base", lambda b: b["base"])

    def named(c: Column) -> Column:
        # a match that fails its check is a candidate only where a word beside it names the kind
        return ~c["base"] & (F.floor(c["votes"] / 3 ** (len(LABELERS) - 1 - LABELERS.index("context"))) % 3 == 2)

    def apart(c: Column) -> Column:
        return ~F.exists("sure", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    told = told.select("doc_id", sure.alias("sure"), F.concat(F.filter("base", named), F.col("loose")).alias("rest"))
    return told.select("doc_id", F.array_sort(F.concat("sure", F.filter("rest", apart))).alias("spans"))


def read_votes(pattern: int) -> list[int]:
    """The votes of a pattern, 0 to 2 each, in the labelers' order."""
    return [pattern // 3 ** (len(LABELERS) - 1 - i) % 3 for i in range(len(LABELERS))]


def expectation_maximisation(counts: dict[int, int]) -> tuple[dict[int, float], list[list[list[float]]]]:
    """Probability that candidates of each vote pattern are right, and each labeler's shares of votes for wrong and right ones.

    counts has at most 3**5 patterns. Every labeler starts from TRUST with the
    weight of PRIOR candidates, which also keeps the two classes from changing places.
    """
    share, rates = 0.5, [[list(t) for t in TRUST] for _ in LABELERS]
    right: dict[int, float] = {}
    n = sum(counts.values())
    for _ in range(ROUNDS):
        for pattern in counts:
            odds = math.log(share) - math.log(1 - share)
            for (wrong, good), v in zip(rates, read_votes(pattern), strict=True):
                odds += math.log(good[v]) - math.log(wrong[v])
            right[pattern] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        share = (PRIOR / 2 + sum(c * right[p] for p, c in counts.items())) / (PRIOR + n)
        for i, trust in enumerate(rates):
            for y in (0, 1):
                seen = [PRIOR * x for x in TRUST[y]]
                for p, c in counts.items():
                    seen[read_votes(p)[i]] += c * (right[p] if y else 1 - right[p])
                trust[y] = [x / sum(seen) for x in seen]
    return right, rates


def probabilities(found: DataFrame) -> list[dict[int, float]]:
    """By kind, the probability of each vote pattern; only pattern counts reach the driver, at most 4 * 3**5."""
    spans = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n"))
    counts: list[dict[int, int]] = [{} for _ in KINDS]
    for row in spans.collect():
        counts[row["kind"]][row["votes"]] = row["n"]
    return [expectation_maximisation(c)[0] for c in counts]


def weights(found: DataFrame, right: list[dict[int, float]]) -> tuple[list[float], list[float]]:
    """Naive Bayes: the log odds of each kind, and of each feature's place, at most 4 * BUCKETS."""
    size = 3 ** len(LABELERS)
    known = F.array(*(F.lit(right[k].get(v, 0.5)) for k in range(len(KINDS)) for v in range(size)))
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", F.get(known, F.col("s.kind") * size + F.col("s.votes")).alias("p"), F.explode("s.features").alias("f"))
    seen = {row["f"]: (row["good"], row["bad"]) for row in spans.groupBy("f").agg(F.sum("p").alias("good"), F.sum(1 - F.col("p")).alias("bad")).collect()}
    n_features = 6
    prior, out = [], []
    for k in range(len(KINDS)):
        own = [seen.get(k * BUCKETS + i, (0.0, 0.0)) for i in range(BUCKETS)]
        good, bad = (sum(x[i] for x in own) / n_features for i in (0, 1))
        prior.append(math.log(good + 1) - math.log(bad + 1))
        # a place seen once says as much as one of two: shares are smoothed towards the kind's own
        whole = (good + 1) / (good + bad + 2)
        for g, b in own:
            out.append(math.log((g + whole) / (good + 1)) - math.log((b + 1 - whole) / (bad + 1)))
    return prior, out


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, kind by name, end, base, probability), sorted; one row per input row."""
    found = cut(candidates(docs))
    prior, placed = weights(found, probabilities(found))
    prior, placed = (F.array(*map(F.lit, x)) for x in (prior, placed))
    names = F.array(*map(F.lit, KINDS))

    def scored(s: Column) -> Column:
        odds = F.aggregate(s["features"], F.get(prior, s["kind"]), lambda a, f: a + F.get(placed, f))
        return F.struct(s["start"], s["kind"].alias("order"), s["end"].alias("end"), F.get(names, s["kind"]).alias("kind"), s["base"].alias("base"), (1 / (1 + F.exp(-odds))).alias("probability"))

    backed = F.array(*(F.lit(sum(read_votes(v)) > len(LABELERS)) for v in range(3 ** len(LABELERS))))
    backed_spans = F.filter("spans", lambda s: s["base"] | F.get(backed, s["votes"]))
    done = found.select("doc_id", F.transform(backed_spans, scored).alias("spans"))
    return done.select("doc_id", F.filter("spans", lambda s: s["base"] | (s["probability"] >= LEAST_PROBABILITY)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.encode(shown(base), "UTF-8"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))

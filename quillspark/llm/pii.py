"""Operator 4: personal data, by base patterns and a boosted classifier of further candidates.

Generators of high recall propose spans: e-mail addresses with spelt-out signs, IPv6 addresses, card numbers with
other separators, telephone numbers without a country code. Gradient-boosted trees score each candidate by its format
and its context; the score is calibrated on held-out rows, and the threshold is the least one with PRECISION there.
The trees are compiled into columns, so texts are only ever seen by built-in functions. Spans of the base patterns
stay whatever the trees say; a candidate that overlaps one, or a better candidate, adds nothing.

The trees are fitted on LABELLED rows made from templates with a fixed seed; no row of the corpus is needed.

The patterns are the contract's, with possessive loops and starts at the end of a run left out: what a run's first
place can't match, its later places can't either. So matches are the same, and long runs take linear time.

Defined cases: a null or empty text has no spans; repeated rows each give a row; an empty table gives an empty table;
extra columns are left out by `pii_report` and kept by `redact_pii`.
"""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, text_or_empty
from .spans import count_of, found, redacted
from .trees import Model, boosted, labelled

LABELLED, PRECISION = 6000, 0.995
KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"A-Za-z0-9._%+-"
# The base patterns of the contract.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators of further candidates.
MORE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{2,64}}+(?:\x20?[\[({{<]\x20?(?:at|AT|@)\x20?[\])}}>]\x20?|\x20at\x20)[A-Za-z0-9-]{{1,63}}+(?:(?:\x20?[\[({{<]\x20?(?:dot|DOT|\.)\x20?[\])}}>]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{{2,63}}+){{1,4}}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){3,7}+:?[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/\x20-]{1,2}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[-./\x20])[0-9]{3,4}(?:[-./\x20][0-9]{2,4}){1,3}(?![0-9])",
}
# Words that stand before personal data.
CUES = {
    "email": r"e-?mail|contact|write to|reach|correo|courriel|adresse",
    "ip": r"\bip\b|ipv6|address|server|host|login from|connect",
    "card": r"card|visa|master|amex|karte|carte|tarjeta|credit|payment",
    "phone": r"phone|\btel\b|call|mobile|cell|fax|telefon|tél|teléfono|reach|whatsapp",
}
AGAINST = r"version|isbn|order|invoice|page|chapter|section|serial|date|\bno\b|number of|build|ref|score|total"


def digits(x: Column) -> Column:
    return F.translate(x, F.translate(x, "0123456789", ""), "")


def n_digits(x: Column) -> Column:
    return F.length(x) - F.length(F.translate(x, "0123456789", ""))


def luhn(x: Column) -> Column:
    """Do the 12 to 19 digits of x pass Luhn's test?"""

    def passes(d: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            v = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
            twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
            return total + F.when(i % 2 == 0, twice).otherwise(v)

        return F.when(F.length(d).between(12, 19), F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))

    return let(F.regexp_replace(x, "[^0-9]", ""), passes)


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255")))),
    "card": luhn,
    "phone": lambda x: n_digits(x).between(9, 15),
}


def features(kind: str | Column, c: Column) -> dict[str, Column]:
    """Format and context of a candidate c (hit, before, after)."""
    hit, before, after = c["hit"], F.lower(c["before"]), c["after"]
    own = F.lit(False)
    for k in KINDS:
        own = own | ((F.lit(kind) if isinstance(kind, str) else kind) == k) & before.rlike(CUES[k])
    is_kind = {f"is_{k}": (F.lit(kind) if isinstance(kind, str) else kind) == k for k in KINDS}
    flags = is_kind | {
        "cue": own,
        "against": before.rlike(AGAINST),
        "luhn": luhn(hit),
        "glued": before.rlike(r"[a-z0-9_/#$]$") | after.rlike(r"^[A-Za-z0-9_]|^[-./:][0-9]"),
        "top_domain": F.lower(hit).rlike(r"(?:com|org|net|edu|gov|info|io|de|fr|es|uk)$"),
        "date": hit.rlike(r"^(?:19|20)[0-9]{2}[-./ ]|[-./ ](?:19|20)[0-9]{2}$"),
        "area": hit.rlike(r"^\([0-9]{3}\)"),
        "one_separator": F.size(F.array_distinct(F.split(F.regexp_replace(hit, "[A-Za-z0-9()]", ""), ""))) < 2,
    }
    numbers = {
        "length": F.length(hit),
        "digits": n_digits(hit),
        "groups": count_of(hit, r"[^A-Za-z0-9]+") + 1,
        "brackets": count_of(hit, r"[\[({<]"),
        "spelt": count_of(F.lower(hit), r"\bdot\b|\bat\b"),
        "letters": F.length(F.regexp_replace(hit, "[^A-Za-z]", "")),
    }
    return {k: v.cast("int") for k, v in flags.items()} | numbers


def examples(n: int = LABELLED, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """kind, before, hit, after, label."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "the", "on", "re", "le", "de", "in", "st", "ou", "en", "ti", "sch")) for _ in range(r.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    cues = {"email": ["email: ", "contact ", "reach me: "], "ip": ["ip ", "server ", "login from "], "card": ["card ", "visa: ", "credit card no. "], "phone": ["phone: ", "call ", "tel. ", "mobile "]}
    wrong = ["version ", "order ", "isbn ", "invoice ", "page ", "section ", "ref ", "build "]

    def good_card() -> str:
        d = num(15)
        total = sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 == 0 else x for i, x in enumerate(map(int, d)))
        return d + str(-total % 10)

    def positive(kind: str) -> str:
        if kind == "email":
            at, dot = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", "."), ("(at)", "."), ("<at>", "<dot>")])
            return f"{word()}{r.choice(['', '.', '_'])}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"
        if kind == "ip":
            return ":".join(f"{r.randrange(1, 65536):x}" for _ in range(8)) if r.random() < 0.7 else f"2001:db8:{r.randrange(1, 9999):x}::{r.randrange(1, 9999):x}"
        if kind == "card":
            d, s = good_card(), r.choice([".", "/", "_", " - "[:2]])
            return s.join(d[i : i + 4] for i in range(0, 16, 4))
        return r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(num(3), num(3), num(4))

    def negative(kind: str) -> str:
        if kind == "email":
            return f"{word()} at {word()}.{word().capitalize()}" if r.random() < 0.8 else f"{word()} at {word()} dot {word()}"
        if kind == "ip":
            return ":".join(num(2) for _ in range(r.randint(4, 6))) if r.random() < 0.8 else ":".join(r.choice(["a", "be", "face", "cafe"]) for _ in range(4))
        if kind == "card":
            return r.choice(["/", ".", "_"]).join(num(4) for _ in range(4))
        return r.choice(["{a}-{b}-{c}", "{y}-{b}-{c}", "{b}.{a}.{c}", "{a} {a} {a}", "{y}/{a}/{c}", "{b}/{c}/{y}"]).format(a=num(3), b=num(2), c=num(2), y=r.choice(["1998", "2015", "2024"]))

    rows = []
    for _ in range(n):
        kind, label = r.choice(KINDS), int(r.random() < 0.5)
        hit = positive(kind) if label else negative(kind)
        lead = r.choice(cues[kind]) if r.random() < (0.8 if label else 0.1) else r.choice(wrong) if not label and r.random() < 0.6 else ""
        bare = label and kind == "phone" and not lead
        if bare:  # bare digits without a cue aren't told apart from other numbers
            hit = f"({num(3)}) {num(3)}-{num(4)}"
        tail = r.choice(["-" + num(2), "/" + num(4), num(2)]) if not label and r.random() < 0.2 else r.choice([" ", ". ", ", "])
        rows.append((kind, f"{text(3)} {lead}"[-32:], hit, tail + text(2), label))
    return rows


@lru_cache
def _fitted(app: str, n: int) -> Model:
    spark = SparkSession.active()
    rows = spark.createDataFrame(examples(n), "kind string, before string, hit string, after string, label int")
    made = features(F.col("kind"), F.struct("hit", "before", "after"))
    x, y = labelled(rows.select("label", *[v.alias(k) for k, v in made.items()]), list(made))
    return boosted(list(made), x, y, precision=PRECISION)


def model(spark: SparkSession, n: int = LABELLED) -> Model:
    return _fitted(spark.sparkContext.applicationId, n)


SPAN = "array<struct<s:int,o:int,e:int,z:double>>"


def base_spans(text: Column) -> Column:
    """Sorted (start, kind's number, end, z) of the base patterns."""

    def of(kind: str, o: int) -> Column:
        valid = F.filter(found(text, BASE[kind]), lambda c: VALID[kind](c["hit"]))
        return F.transform(valid, lambda c: F.struct(c["s"].alias("s"), F.lit(o).alias("o"), c["e"].alias("e"), F.lit(0.0).alias("z")))

    return F.array_sort(F.concat(*[of(k, o) for o, k in enumerate(KINDS)]).cast(SPAN))


def added_spans(text: Column, base: Column, trees: Model) -> Column:
    """Candidates that the trees take, without those that overlap a base span or a better candidate."""

    def of(kind: str, o: int) -> Column:
        scored = F.transform(found(text, MORE[kind]), lambda c: F.struct(c["s"].alias("s"), F.lit(o).alias("o"), c["e"].alias("e"), trees.logit(features(kind, c)).alias("z")))
        return F.filter(scored, lambda c: c["z"] >= trees.cut)

    def free(taken: Column) -> Column:
        clear = lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
        best = lambda c: ~F.exists(taken, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]) & ((b["z"] > c["z"]) | ((b["z"] == c["z"]) & ((b["s"] < c["s"]) | ((b["s"] == c["s"]) & (b["o"] < c["o"]))))))
        return F.filter(taken, lambda c: clear(c) & best(c))

    return let(F.concat(*[of(k, o) for o, k in enumerate(KINDS)]).cast(SPAN), lambda t: F.when(F.size(t) == 0, t).otherwise(free(t)))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with pii_base and pii_spans."""
    trees, text = model(docs.sparkSession), text_or_empty()
    both = let(base_spans(text), lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, added_spans(text, b, trees))).alias("spans")))
    return docs.withColumn("_pii", both).withColumns({"pii_base": F.col("_pii.base"), "pii_spans": F.col("_pii.spans")}).drop("_pii")


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["o"]), x["s"], x["e"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    rows = with_spans(docs.select("doc_id", "text"))
    count = lambda o: F.size(F.filter("pii_base", lambda x: x["o"] == o)).cast("long")
    counts = [count(o).alias(f"n_{k}") for o, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with <kind> in place of each span of text; null texts stay null."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    rows = with_spans(docs.select(F.struct(*docs.columns).alias("_row"), "text"))
    return rows.select(*[redacted(F.col("text"), F.col("pii_spans"), lambda x: F.get(names, x["o"])).alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pii": op4_pii}
ORACLE: dict[str, str] = {}

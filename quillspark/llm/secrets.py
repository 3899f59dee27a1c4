"""Operator 6: secret scans with a random forest for false positives.

One pattern proposes every token of at least MIN_CHARS key characters with a digit. A random forest judges each by
its length, its share of digits, its changes of character class, the part of it that dictionary words cover, whether
it is a piece of a path or address, and the words beside it. The forest is fitted on LABELLED findings made from
templates with a fixed seed, is calibrated on held-out ones, and takes what reaches the least threshold of PRECISION
there. It is compiled into columns; texts are only seen by built-in functions, and nothing is shuffled.

Defined cases: a null or empty text has no candidates; repeated rows each give a row; an empty table gives an empty
table; extra columns are left out by `secret_report` and kept by `redact_secrets`.
"""

from __future__ import annotations

import random
import string
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, text_or_empty
from .spans import count_of, found, redacted
from .trees import Model, forest, labelled

LABELLED, PRECISION, MIN_CHARS = 6000, 0.99, 12
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{{MIN_CHARS},}}+={{0,2}}"
# Words that names in code and addresses are made of, and words beside findings and beside other numbers.
DICTIONARY = (
    "account address admin android api app archive article asset author backup build cache chapter class client code com config content count customer data date default demo detail dev device doc document "
    "download draft edition error event example export file final folder font form format group home host html http https icon image img index info input item java js json key lib line link list local log "
    "login main map media member menu message model module name net news node note number object option order org output page part path photo plan post price print product profile project public query "
    "random record release report request result sample score script search section server service session set shop site size source spark start state static status step store string style system table tag task "
    "team test text theme thread time title tool type update upload url user util value version video view web week window work www year the and for with from"
).split()
NEAR = r"secret|token|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer|akia|\bkey\b"
FAR = r"sha-?1|sha-?256|md5|commit|hash|checksum|digest|uuid|guid|isbn|order|invoice|revision|etag|build"
NAMES = ("length", "digits", "uppers", "changes", "coverage", "hexadecimal", "dashes", "slashes", "path", "assigned", "quoted", "near", "far", "known_prefix")


def features(c: Column) -> dict[str, Column]:
    hit, before, after = c["hit"], F.lower(c["before"]), c["after"]
    n = F.length(hit)
    words = r"(?:" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"
    return {
        "length": n,
        "digits": count_of(hit, "[0-9]") / n,
        "uppers": count_of(hit, "[A-Z]") / n,
        "changes": count_of(hit, "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        "coverage": 1 - F.length(F.regexp_replace(F.lower(hit), words, "")) / n,
        "hexadecimal": hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"),
        "dashes": count_of(hit, "[-_]"),
        "slashes": count_of(hit, "/"),
        "path": (before.rlike(r"(?:://|www\.)\S*$|[/\\.?&#]$") | after.rlike(r"^(?:\.[A-Za-z]{2,5}\b|[/\\?&])")).cast("int"),
        "assigned": before.rlike(r"[=:]\s?[\"'`]?$").cast("int"),
        "quoted": before.rlike("[\"'`]$").cast("int"),
        "near": before.rlike(NEAR).cast("int"),
        "far": before.rlike(FAR).cast("int"),
        "known_prefix": hit.rlike("^(?:AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|sk-|AIza|eyJ|glpat-)").cast("int"),
    }


def examples(n: int = LABELLED, seed: int = 23) -> list[tuple[str, str, str, int]]:
    """before, hit, after, label."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "the", "on", "re", "le", "de", "in", "st", "ou", "en", "ti", "sch")) for _ in range(r.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, mixed, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + "234567"

    def positive() -> tuple[str, str, str]:
        kind = r.randrange(5)
        lead = r.choice(["password=", "token = \"", "secret: ", "api_key='", "api key ", "Authorization: Bearer ", "access_key = ", "pwd: ", "credentials \""])
        if kind == 0:
            return "", "AKIA" + some(upper + "0189", 16), " "
        if kind == 1:
            return lead, some(hexa, r.choice([16, 18, 20, 24, 32, 36, 40])), r.choice(['"', "'", " "])
        if kind == 2:
            return lead, some(mixed, r.randint(16, 44)), r.choice(['"', "'", " "])
        if kind == 3:
            return r.choice(["", lead]), r.choice(["ghp_", "sk_live_", "xoxb-", "AIza", "glpat-", "eyJ"]) + some(mixed, r.randint(20, 40)), r.choice(['"', " "])
        return lead, some(mixed + "+/", r.choice([27, 38, 43])) + "=", r.choice(['"', " "])

    def negative() -> tuple[str, str, str]:
        kind = r.randrange(8)
        name = lambda: r.choice(["-", "_"]).join([r.choice(DICTIONARY) for _ in range(r.randint(2, 4))] + [some("0123456789", r.randint(1, 5))])
        if kind == 0:
            return r.choice(["commit ", "sha256: ", "md5 ", "checksum: ", "etag \""]), some(hexa, r.choice([20, 32, 40, 64])), " "
        if kind == 1:
            return r.choice(["uuid ", "id: ", "", "guid="]), str(uuid.UUID(int=r.getrandbits(128))), " "
        if kind == 2:
            return r.choice(["https://www.", "http://", "see /"]) + word() + "/", name(), r.choice([".html", "/", "?", " "])
        if kind == 3:
            return r.choice(["", "file ", "open "]), name(), r.choice([".png", ".js", " "])
        if kind == 4:
            return r.choice(["order ", "isbn ", "invoice ", "", "card "]), some("0123456789", r.randint(12, 20)), " "
        if kind == 5:
            return "", f"{some('0123456789', 4)}-{some('0123456789', 2)}-{some('0123456789', 2)}" + some("0123456789", 4), " "
        if kind == 6:
            return "", word() + word() + word() + some("0123456789", r.randint(1, 4)) + word(), " "
        return r.choice(["token count ", "key ", "secret "]), name(), " "

    rows = []
    for _ in range(n):
        label = int(r.random() < 0.5)
        lead, hit, tail = positive() if label else negative()
        if len(hit) >= MIN_CHARS and any(x.isdigit() for x in hit):
            rows.append((f"{text(3)} {lead}"[-32:], hit, tail + text(2), label))
    return rows


@lru_cache
def _fitted(app: str, n: int) -> Model:
    spark = SparkSession.active()
    rows = spark.createDataFrame(examples(n), "before string, hit string, after string, label int")
    x, y = labelled(rows.select("label", *[v.alias(k) for k, v in features(F.struct("hit", "before", "after")).items()]), list(NAMES))
    return forest(list(NAMES), x, y, precision=PRECISION)


def model(spark: SparkSession, n: int = LABELLED) -> Model:
    return _fitted(spark.sparkContext.applicationId, n)


def with_secrets(docs: DataFrame) -> DataFrame:
    """docs with n_candidates and secret_spans (s, e)."""
    trees = model(docs.sparkSession)

    def judged(c: Column) -> Column:
        made = F.struct(*[v.cast("double").alias(k) for k, v in features(c).items()])
        return let(made, lambda f: trees.logit({n: f[n] for n in NAMES})) >= trees.cut

    both = let(found(text_or_empty(), CANDIDATE), lambda c: F.struct(F.size(c).cast("long").alias("n"), F.transform(F.filter(c, judged), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("spans")))
    return docs.withColumn("_secrets", both).withColumns({"n_candidates": F.col("_secrets.n"), "secret_spans": F.col("_secrets.spans")}).drop("_secrets")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (start:end in code points, comma-joined)."""
    spans = F.array_join(F.transform("secret_spans", lambda x: F.concat_ws(":", x["s"], x["e"])), ",")
    return with_secrets(docs.select("doc_id", "text")).select("doc_id", "n_candidates", F.size("secret_spans").cast("long").alias("n_secrets"), spans.alias("spans"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with <secret> in place of each finding; null texts stay null."""
    rows = with_secrets(docs.select(F.struct(*docs.columns).alias("_row"), "text"))
    return rows.select(*[redacted(F.col("text"), F.col("secret_spans"), lambda x: F.lit("<secret>")).alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLE: dict[str, str] = {}

"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

import json
import random
import string

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.textops import free_name

_NAMED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credentials?|auth)[\"']?[ \t]*+[=:][ \t]*+[\"']?"
_IN_URL = r"://[^\s/:@\"']{1,64}+:"  # a user before the password
_KEY = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,24}PRIVATE KEY-----)?"
#: Private key blocks, passwords in urls, named values of 6 characters or more, runs of 16 or more with a digit.
CANDIDATE = rf"{_KEY}|{_IN_URL}[^\s/@\"']{{6,128}}+(?=@)|{_NAMED}[^\s\"',;]{{6,}}+|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{16,}}+"
#: Words of placeholders, identifiers and plain prose, which secrets are not made of.
DICTIONARY = (
    "about above access account action active address admin after alpha always another answer api app application archive area array article asset async attribute author back base before below beta between body book bool "
    "boolean branch browser buffer build button cache call case change changeme channel chapter char check class clean client close cloud code collection color column command comment common company component config connect console "
    "container content context control copy core count country create current custom data database date debug default delete demo deploy description design detail device dev dictionary directory display document domain download draft driver dummy edit element "
    "email empty engine entry error event example export false feature field figure file filter final first folder font form format frame function global group guide handler header height hello help here home host html http image import "
    "index info input insert install int item job json key label language last layout left level library line link list local log login long main manager map master media member menu message method model module month name network new none null number "
    "object option order output package page param parent password path pattern payload pending person phone placeholder plugin point policy port post prefix preview private process product profile project property public query random read record redacted "
    "region release remove replace report request required reset resource response result return right role root route row sample schema screen script search secret section select server service session set setting sheet short simple site size source "
    "staging start state static status step store stream string style system table tag target task team template test text theme thread time title token tool total track true type undefined update upload url user utils value variable version video view "
    "web welcome widget width window word work world write year your"
).split()
FEATURES = ["length", "digits", "uppers", "lowers", "others", "hex", "distinct", "changes", "vowels", "longest_letters", "dictionary", "known", "named", "assigned", "quoted", "path", "digest_word", "secret_word", "dashes"]
_DIGEST = r"(?i)\b(?:commit|sha|sha1|sha256|md5|hash|checksum|digest|uuid|guid|rev|revision|etag|build|version|isbn|doi|order|invoice|id|session)\b[^A-Za-z0-9]{0,4}$"
_SECRET = r"(?i)(?:passw|pwd|secret|token|key|credential|auth|bearer)[^\s]*[^A-Za-z0-9]{0,6}$"


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def with_features(findings: DataFrame) -> DataFrame:
    """Findings (value, before, after) with FEATURES; nulls count as empty."""
    v, before, after = (F.coalesce(F.col(c), F.lit("")) for c in ("value", "before", "after"))
    n = F.greatest(F.length(v), F.lit(1))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.regexp_replace(kinds, r"(.)\1*", "x")
    words = F.regexp_replace(F.lower(v), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    is_ = lambda c: c.cast("double")
    columns = {
        "length": F.length(v).cast("double"),
        "digits": _share(v, "[^0-9]"), "uppers": _share(v, "[^A-Z]"), "lowers": _share(v, "[^a-z]"), "others": _share(v, "[A-Za-z0-9]"), "hex": _share(v, "[^0-9a-f]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "changes": F.length(runs) / n,
        "vowels": _share(v, "(?i)[^aeiou]"),
        "longest_letters": F.coalesce(F.array_max(F.transform(F.split(v, "[^A-Za-z]+"), lambda w: F.length(w))), F.lit(0)) / n,
        "dictionary": 1 - F.length(words) / n,
        "known": is_(v.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{20,}|^xox[abprs]-|^eyJ[A-Za-z0-9_-]{10,}|^sk[-_][A-Za-z0-9]{16,}|^-----BEGIN")),
        "named": is_(before.rlike(f"(?:{_NAMED}|{_IN_URL})$")),
        "assigned": is_(before.rlike(r"[=:]\s{0,3}[\"']?$")),
        "quoted": is_(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "path": is_(before.rlike(r"(?:[/\\]|://\S*|\.)$") | after.rlike(r"^[./\\][A-Za-z0-9]") | v.rlike(r"^[^/]*(?:/[A-Za-z_.-]{2,}){2,}")),
        "digest_word": is_(before.rlike(_DIGEST)),
        "secret_word": is_(before.rlike(_SECRET)),
        "dashes": _share(v, "[^-_]"),
    }
    return findings.withColumns({k: c.cast("double") for k, c in columns.items()})


def labelled_findings(spark: SparkSession, each: int = 150) -> DataFrame:
    """(value, before, after, label): findings as scans meet them, made by rule from hashes of their number.

    Label 1: keys of known form, random hexadecimal and mixed values assigned to secret names. Label 0: digests,
    uuids, commits, numbers, versions, slugs, paths, placeholders, repeated characters. Thirty kinds, ``each``
    of every kind.
    """
    rows = [dict(zip(("value", "before", "after", "label"), r, strict=True)) for i in range(each) for r in _made(i)]
    schema = "array<struct<value:string,before:string,after:string,label:double>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def _made(i: int) -> list[tuple[str, str, str, float]]:
    """One finding of every kind."""
    draw = random.Random(i)  # the same at each run
    hexa = lambda n: "".join(draw.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(draw.choices(string.ascii_letters + string.digits, k=n))
    digits = lambda n: "".join(draw.choices(string.digits, k=n))
    key = lambda: "AKIA" + "".join(draw.choices(string.ascii_uppercase + "234567", k=16))
    pick = draw.choice
    syllables = ["the", "ring", "ver", "sion", "art", "chap", "ter", "im", "age", "sec", "tion", "re", "port", "an", "nual", "up", "date", "of", "er", "ation", "eau", "ment", "keit", "dad"]
    word = lambda: "".join(draw.choices(syllables, k=draw.randint(2, 4)))
    prose = lambda: pick([word() + " ", word() + " " + word() + ", ", "", "see ", "with the ", word() + ". "])
    named = lambda: prose() + pick(["password", "token", "secret", "api_key", "passwd", "API-KEY", "access_key", "Token", "pwd"]) + pick(["=", ": ", " = ", '="', ' = "', ": '", " : "])
    holders = ["your_password_here", "changeme123", "example_token_1", "your-api-key-0", "insert_secret_1", "password123", "test_token", "placeholder1", "dummy_value", "redacted00"]
    code = ["os.environ", "config.get", "getpass()", "<password>", "${TOKEN}", "required", "string", "process.env", "undefined", "user.password"]
    u = hexa(32)
    kinds = [
        (key(), prose(), 1), (key(), named(), 1), ("ghp_" + mixed(36), prose(), 1), ("sk_" + mixed(24), prose(), 1), (hexa(draw.randint(12, 64)), named(), 1), (hexa(draw.randint(16, 40)), named(), 1),
        (mixed(20), named(), 1), (mixed(9) + "!x9" + hexa(3), named(), 1), (mixed(40), named(), 1), (mixed(40), prose(), 1), ("eyJ" + mixed(40), prose(), 1), ("-----BEGIN RSA PRIVATE KEY-----", prose(), 1),
        (hexa(40), prose() + pick(["commit ", "sha1: ", "sha ", "rev ", "commit="]), 0), (hexa(64), prose() + pick(["sha256:", "checksum: ", "digest ", "hash="]), 0), (hexa(32), prose() + pick(["md5 ", "md5:", 'etag: "', "hash "]), 0),
        ("-".join((u[:8], u[8:12], u[12:16], u[16:20], u[20:])), prose() + pick(["uuid ", "id: ", "session ", ""]), 0), (digits(draw.randint(16, 24)), prose(), 0), ("-".join(digits(4) for _ in range(4)), prose() + pick(["order ", "", "invoice "]), 0),
        ("-".join((word(), word(), word(), digits(3))), pick(["/", "see ", "https://host/", ""]), 0), ("/".join((word(), word(), word() + digits(2))), pick(["/", "https://", " ", "path: "]), 0), ("_".join((word(), word(), word(), digits(2))), prose(), 0),
        (pick(holders), named(), 0), (pick("x0*a") * 20 + "1", named(), 0), (pick([word() + word() + word() + digits(1), pick(code), word() + "-" + digits(1) + "-" + digits(2) + "-" + digits(8)]), prose(), 0),
    ] + [
        (mixed(draw.randint(8, 20)) + pick("!#$%"), prose() + pick(["postgres", "https", "amqp"]) + "://" + word() + ":", 1), (mixed(draw.randint(10, 24)), prose() + "://" + pick(["root", "admin", word()]) + ":", 1),
        (mixed(draw.randint(12, 24)), prose() + pick(["credential: ", "auth=", "credentials = ", 'auth": "']), 1), ("-----BEGIN PRIVATE KEY-----\n" + mixed(64) + "\n" + mixed(20) + "==\n-----END PRIVATE KEY-----", prose(), 1),
        (pick(["password", "yourpassword", "changeme", "placeholder", "secret-here"]), prose() + "://user:", 0), (pick(["required", "disabled", "undefined", word() + word(), "optional", "None,None"]), prose() + pick(["auth: ", "auth=", "credentials: ", "token: "]), 0),
    ]
    close = lambda before: before[-1:] + " " if before[-1:] in ("'", '"') else pick([" ", " and", ".", ", ", "\n", ""])
    return [(v, b, close(b), float(label)) for v, b, label in kinds]


class SecretScan:
    """``context`` characters on either side of a candidate are looked at; ``threshold`` is on the forest's share of trees."""

    def __init__(self, threshold: float = 0.5, context: int = 48, trees: int = 20, depth: int = 6, each: int = 150):
        self.threshold, self.context, self.trees, self.depth, self.each = threshold, context, trees, depth, each

    def fit(self, findings: DataFrame):
        forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=self.trees, maxDepth=self.depth, seed=11, featureSubsetStrategy="onethird")
        return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(with_features(findings))

    def candidates(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, tag, start, value, before, after) of each candidate; start counts characters from 0."""
        c = self.context
        d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
        d = d.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), 0)).where(F.size("found") > 0)
        d = d.select("doc_id", F.xxhash64("text").alias("tag"), "found", F.split("text", CANDIDATE).alias("rest"))
        # where each candidate stands; from here on rows hold its surroundings, not the text. Lambdas see their element
        # alone: what else they named would be computed again for each
        n = F.size("found")
        near = lambda m, r: F.struct(m.alias("match"), F.length(r).alias("gap"), F.right(r, F.lit(c)).alias("left"))
        ends = F.transform(F.slice("rest", F.lit(2), n), lambda r: F.left(r, F.lit(c)))
        d = d.select("doc_id", "tag", F.arrays_zip(F.zip_with("found", F.slice("rest", F.lit(1), n), near).alias("near"), ends.alias("right")).alias("places"))
        step = lambda acc, p: F.struct(F.concat(acc["out"], F.array(acc["at"] + p["near"]["gap"])).alias("out"), (acc["at"] + p["near"]["gap"] + F.length(p["near"]["match"])).alias("at"))
        none = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
        at = F.aggregate("places", none, step, lambda acc: acc["out"])
        d = d.select("doc_id", "tag", F.explode(F.arrays_zip("places", at.alias("at"))).alias("p"))
        d = d.select("doc_id", "tag", "p.at", "p.places.near.match", "p.places.near.left", "p.places.right")
        name = F.regexp_extract("match", f"^(?:{_NAMED}|{_IN_URL})", 0)
        value = F.substring(F.col("match"), F.length(name) + 1, F.length("match"))
        return d.select("doc_id", "tag", (F.col("at") + F.length(name)).alias("start"), value.alias("value"), F.concat("left", name).alias("before"), F.col("right").alias("after"))

    def run(self, docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, tag, start, value, score) of each secret; tag is xxhash64 of its text.

        The forest learns from ``findings`` (value, before, after, label), by default those of
        ``labelled_findings``. Null and empty texts hold none; rows that repeat give repeated findings; null ids
        are kept; other columns are not read.
        """
        model = self.fit(labelled_findings(docs.sparkSession, self.each) if findings is None else findings)
        scored = model.transform(with_features(self.candidates(docs, id_col, text)))
        scored = scored.withColumn("score", F.element_at(vector_to_array("probability"), 2))
        return scored.where(F.col("score") >= self.threshold).select("doc_id", "tag", "start", "value", "score")

    def redact(self, docs: DataFrame, findings: DataFrame | None = None, mask: str = "[secret]") -> DataFrame:
        """``docs`` with each secret in ``text`` replaced; all rows and columns stay."""
        found = self.run(docs, findings)
        own_id, own_tag, own_spans = (free_name(docs.columns, c) for c in ("id", "tag", "spans"))
        spans = found.select("doc_id", "tag", "start", F.length("value").alias("n")).distinct()
        spans = spans.groupBy(F.col("doc_id").alias(own_id), F.col("tag").alias(own_tag)).agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias(own_spans))
        own = F.xxhash64("text").eqNullSafe(F.col(own_tag)) & docs["doc_id"].eqNullSafe(F.col(own_id))
        between = lambda acc, s: F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        step = lambda acc, s: F.struct(F.concat(acc["out"], F.array(between(acc, s), F.lit(mask))).alias("out"), (s["start"] + s["n"]).alias("at"))
        last = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, F.length("text")))), "")
        done = F.aggregate(own_spans, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")), step, last)
        joined = docs.join(spans, own, "left").withColumn("text", F.when(F.size(own_spans) > 0, done).otherwise(F.col("text")))
        return joined.select(*docs.columns)

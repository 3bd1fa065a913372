"""Secret scans in SQL expressions: candidates by shape, then a random forest that takes out false positives.

The forest sees a candidate's length, the transitions between its kinds of characters, how much of it dictionary words cover,
whether it is part of a path, and the words beside it. It is trained from labelled findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.tables import pick, row_key, store

KEY = ["doc_id", "key_a", "key_b"]
#: A run of characters that a secret can be made of.
RUN = r"[A-Za-z0-9+/_=-]{12,}"
#: A candidate has a digit, is written in capitals, has letters whose case changes twice in a row, as in random values, or
#: stands behind an assignment or a word for secrets.
_SIGN = "[0-9]|[A-Z]{12}|[a-z][A-Z]+[a-z]|[A-Z][a-z]+[A-Z]"
_BESIDE = 48

# Words that stand beside secrets, words that stand beside harmless look-alikes, and words of the dictionary.
KEY_WORDS = "password passwd pwd secret token apikey api_key api-key auth credential bearer private access"
PLAIN_WORDS = "commit sha md5 hash checksum uuid guid isbn example sample card phone call order invoice tracking version"
#: Names that end in ``key`` and name no secret.
OPEN_KEYS = "public primary foreign sort cache partition unique index object license"
DICTIONARY = (
    "the and ing ion ent for this that with from test user data file path name image index page http www com html json "
    "example sample demo default change me your here key value number version build release abc qwerty admin root 123456"
)
# What the keys and tokens of public services look like.
VENDOR_KEYS = (
    "(AKIA|ASIA)[0-9A-Z]{16}",
    "gh[pousr]_[A-Za-z0-9]{20,}",
    "github_pat_[A-Za-z0-9_]{20,}",
    "glpat-[A-Za-z0-9_-]{16,}",
    "(sk|rk)_(live|test)_[A-Za-z0-9]{10,}",
    "sk-[A-Za-z0-9_-]{20,}",
    "xox[abprs]-[0-9A-Za-z-]{10,}",
    "AIza[0-9A-Za-z_-]{30,}",
    "npm_[A-Za-z0-9]{30,}",
    "hf_[A-Za-z0-9]{20,}",
)
#: The line before the body of a private key, and what parts the lines of a body.
_KEY_BEGIN = r"PRIVATE KEY( BLOCK)?-----(\s|\\[rn]?)*$"
_KEY_LINE = r"^(\s|\\[rn]?){1,2}$"
REPLACEMENT = "[secret]"


@dataclass(frozen=True)
class SecretScan:
    """``sample`` labelled findings of each label at most train ``trees`` trees of ``depth``; a candidate is a finding from a
    probability of ``least`` on."""

    sample: int = 2000
    trees: int = 24
    depth: int = 6
    least: float = 0.5


def _any_of(words: str) -> str:
    return "|".join(words.split())


_KEY_NAME = f"({_any_of(KEY_WORDS)}|(?<!{_any_of(OPEN_KEYS)})[_-]key|(secret|private|access|api|auth|sign|signing|master)key)[\\s\"':=]*"
_KEY_BESIDE = _KEY_NAME + "$"
_ASSIGNED = "[=:]\\s*[\"']?"


_PASSWORD_NAME = "(password|passwd|passphrase|pwd)"
_GIVEN_TO = f"{_PASSWORD_NAME}[\"']?\\s{{0,4}}[:=]\\s{{0,4}}[\"']?"
_IN_URL = r"://[^\s:/@]{1,64}:"
#: A value given to a name for passwords, or the password of an address: any characters but blanks and quotes, 6 at least.
GIVEN = f"(?i)({_GIVEN_TO}[^\\s\"'`]{{5,}}[^\\s\"'`.,;:!?)\\]}}]|{_IN_URL}[^\\s/@]{{6,}}(?=@))"


def candidates(documents: DataFrame) -> DataFrame:
    """One row per candidate: key of its text, ``value``, ``start`` (character offset), ``name`` (of an assignment), ``left`` and
    ``right`` (the text beside it), ``in_key`` (a line of a private key's body or a part of a signed web token). Null texts have
    none. A run of ``RUN`` that lies inside a value of ``GIVEN`` is no candidate of its own."""
    docs = pick(documents, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    both = _runs(docs).withColumn("wide", F.lit(False)).unionByName(_given(docs).withColumn("wide", F.lit(True)))
    stop = F.col("start") + F.length("value")
    along = Window.partitionBy(*KEY).orderBy("start", F.col("wide").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = F.max(F.when(F.col("wide"), stop)).over(along)
    rows = both.withColumn("covered", F.coalesce(covered, F.lit(0).cast("long")))
    return rows.filter(F.col("wide") | (stop > F.col("covered"))).select(*KEY, "start", "value", "name", "left", "right", "in_key")


def _given(docs: DataFrame) -> DataFrame:
    """Candidates by what stands before them, of any characters."""
    said = F.lower("text")
    may = said.contains("passw") | said.contains("pwd") | said.contains("passphrase") | said.contains("://")
    docs = docs.filter(may & F.col("text").rlike(GIVEN)).select("doc_id", *row_key(F.col("text")), "text").distinct()
    found = docs.select(*KEY, F.regexp_extract_all("text", F.lit(GIVEN), F.lit(0)).alias("found"), F.split("text", GIVEN, -1).alias("between"))
    size = lambda i: F.length(F.get("between", i)) + F.length(F.coalesce(F.get("found", i - 1), F.lit("")))
    # Where each match starts: the gaps and matches before it.
    starts = F.aggregate(
        F.sequence(F.lit(0), F.size("found") - 1),
        F.array().cast("array<long>"),
        lambda done, i: F.array_append(done, F.coalesce(F.element_at(F.when(F.size(done) > 0, done), -1), F.lit(0).cast("long")) + size(i)),
    )
    found = found.withColumn("starts", starts)
    at = F.posexplode("found").alias("at", "whole")
    rows = found.select(*KEY, "starts", "between", "found", at)
    value = F.regexp_replace("whole", f"(?i)^({_GIVEN_TO}|{_IN_URL})", "")
    head = F.length("whole") - F.length("value")
    rows = rows.withColumn("value", value)
    before = F.concat(F.get("between", F.col("at")), F.substr("whole", F.lit(1), head))
    return rows.select(
        *KEY,
        (F.get("starts", F.col("at")) + head).cast("long").alias("start"),
        "value",
        F.lit("").alias("name"),
        F.right(before, F.lit(_BESIDE)).alias("left"),
        F.left(F.get("between", F.col("at") + 1), F.lit(_BESIDE)).alias("right"),
        F.lit(False).alias("in_key"),
    )


def _runs(docs: DataFrame) -> DataFrame:
    """Candidates by their shape: runs of the characters that keys and tokens are made of."""
    docs = docs.select("doc_id", *row_key(F.col("text")), "text").filter(F.col("text").rlike(RUN))
    runs = docs.select(*KEY, F.regexp_extract_all("text", F.lit(RUN), F.lit(0)).alias("runs"), "text")
    runs = runs.filter(F.exists("runs", lambda r: r.rlike(_SIGN)) | F.col("text").rlike(f"(?i)({_KEY_NAME}|{_ASSIGNED}){RUN}"))
    between = F.transform(
        F.split("text", RUN, -1),
        lambda x: F.struct(F.length(x).alias("size"), F.right(x, F.lit(_BESIDE)).alias("tail"), F.left(x, F.lit(_BESIDE)).alias("head"), F.when(x.rlike(_KEY_BEGIN), True).when(~x.rlike(_KEY_LINE), False).alias("opens")),
    )
    prev = F.concat(F.array(F.lit("")), F.slice("runs", F.lit(1), F.size("runs") - 1))
    both = runs.select(*KEY, "runs", between.alias("between"), prev.alias("prev"))
    rows = both.select(*KEY, F.slice("between", 1, F.size("runs")).alias("between"), "runs", F.slice("between", 2, F.size("runs")).alias("after"), "prev")
    one = F.posexplode(F.arrays_zip("between", "runs", "after", "prev")).alias("at", "x")
    rows = rows.select(*KEY, one).select(
        *KEY, "at", F.col("x.runs").alias("run"), F.col("x.between.size").alias("gap"),         F.right(F.concat("x.prev", "x.between.tail"), F.lit(_BESIDE)).alias("left"), F.col("x.after.head").alias("right"), F.col("x.between.opens").alias("opens"),
        ((F.col("x.between.size") == 1) & F.endswith("x.between.tail", F.lit(".")) & F.col("x.prev").rlike("(^|=)eyJ")).alias("signed"),
    )
    before = Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("gap") + F.length("run")).over(before) - F.length("run")
    in_key = F.col("signed") | F.coalesce(F.last("opens", True).over(before), F.lit(False))
    rows = rows.distinct().withColumn("start", start).withColumn("in_key", in_key)
    name = F.regexp_extract("run", r"^([A-Za-z][A-Za-z0-9_-]*)=(?=[^=])", 1)
    value = F.when(name != "", F.substr("run", F.length(name) + 2)).otherwise(F.col("run"))
    skip = F.when(name != "", F.length(name) + 1).otherwise(0)
    rows = rows.withColumn("name", name).withColumn("value", value).withColumn("start", (F.col("start") + skip).cast("long"))
    given = (F.col("name") != "") | F.col("left").rlike(f"{_ASSIGNED}$") | _said().rlike(_KEY_BESIDE)
    return rows.filter((F.length("value") >= 12) & (F.col("value").rlike(_SIGN) | given)).select(*KEY, "start", "value", "name", "left", "right", "in_key")


_PASSWORD = _PASSWORD_NAME + "[\"']?\\s*[:=]\\s*[\"']?$"


def _said() -> Column:
    """The words in front of a candidate, with the name that it is assigned to."""
    return F.lower(F.concat("left", F.lit(" "), "name"))


def _share(pattern: str) -> Column:
    """The share of a candidate's characters that the pattern takes."""
    rest = F.regexp_replace(F.lower("value"), pattern, "")
    return 1 - F.length(rest) / F.length("value")


def features() -> dict[str, Column]:
    """What the forest sees of a candidate."""
    said = _said()
    turns = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "f_length": F.least(F.length("value"), F.lit(80)).cast("double"),
        "f_turns": F.regexp_count("value", F.lit(turns)) / F.length("value"),
        "f_digits": _share("[0-9]"),
        "f_hex": _share("[0-9a-f]"),
        "f_upper": F.length(F.regexp_replace("value", "[^A-Z]", "")) / F.length("value"),
        "f_variety": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
        "f_words": _share(_any_of(DICTIONARY)),
        "f_path": flag(F.col("value").contains("/") | F.col("left").rlike(r"[/\\.]$") | F.col("right").rlike(r"^[/\\]|^\.[a-z]")),
        "f_key_word": flag(said.rlike(_KEY_BESIDE)),
        "f_plain_word": flag(said.rlike(f"\\b({_any_of(PLAIN_WORDS)})\\b")),
        "f_assigned": flag((F.col("name") != "") | F.col("left").rlike(f"{_ASSIGNED}$")),
        "f_format": flag(_settled_format()),
        "f_quoted": flag(F.col("left").rlike("[\"']$") & F.col("right").rlike("^[\"']")),
    }


def _settled_format() -> Column:
    """The value itself, or the block that it is part of, has the format of a secret."""
    vendor = F.col("value").rlike(f"^({'|'.join(VENDOR_KEYS)})$") | F.col("value").rlike("^eyJ[A-Za-z0-9_-]{10,}$")
    return vendor | (F.col("in_key") & (F.length("value") >= 16))


def known_format() -> Column:
    """The label of a candidate whose format settles it, null for all others.

    1: keys and tokens of public services, signed web tokens, bodies of private keys, long random values beside a word or name
    for secrets, and shorter ones given to a name for passwords or standing as the password of an address. 0: calls,
    placeholders and short words in small letters, and, unless a word for secrets stands beside, values without a letter, UUIDs,
    values beside words for harmless look-alikes, paths, plain words, also in CamelCase.
    """
    said, value = _said(), F.col("value")
    beside = said.rlike(_KEY_BESIDE)
    random = value.rlike("[A-Za-z]") & value.rlike(_SIGN)
    given = beside & (F.length("value") >= 16) & random
    password = F.concat(said, F.when(F.col("name") != "", F.lit("=")).otherwise("")).rlike(_PASSWORD + "|" + _PASSWORD[:-1] + "\\s$") & random
    in_url = F.col("left").rlike(f"{_IN_URL}$") & F.startswith("right", F.lit("@")) & random
    path = value.contains("/") & (F.col("left").rlike(r"[/\\.:]$") | F.col("right").rlike(r"^[/\\]|^\.[a-z]") | value.rlike("^/"))
    plain = ~value.rlike(_SIGN) | ~value.rlike("[A-Za-z]") | value.rlike("^[A-Z]?[a-z]{2,}([A-Z][a-z]{2,})+$")
    uuid = value.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    harmless = said.rlike(f"\\b({_any_of(PLAIN_WORDS)})\\b")
    settled = _settled_format() | given | ((password | in_url) & ~_placeholder())
    return F.when(settled, 1.0).when(_placeholder(), 0.0).when(~beside & (plain | uuid | harmless | path), 0.0)


def _placeholder() -> Column:
    """Short words in small letters, calls, and names that stand for a value to be put in."""
    return F.col("value").rlike(r"^[a-z_-]{1,11}$|^[A-Za-z_.]+[\[(]|^([$%]|\{\{|[$]?\{|<)|^[*x.]+$")


def train(labelled: DataFrame, how: SecretScan = SecretScan()) -> RandomForestClassificationModel | None:
    """A forest from candidates with a ``label`` (1: secret, 0: not); None unless both labels occur.

    The sample is the candidates with the smallest digests of each label; it is bounded by ``2 * sample`` rows. Before they are
    ranked, digests are cut where about four times the sample is left, so what meets on a label does not grow with the table.
    """
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    digest = F.xxhash64("value", "left", "start")
    low = digest / F.lit(2.0**64) + 0.5
    few = [(F.col("label") == label) & (low <= min(1.0, 4 * how.sample / n)) for label, n in sorted(sizes.items())]
    labelled = labelled.filter(few[0] | few[1])
    seen = labelled.select(*(c.alias(n) for n, c in features().items()), "label", "value", "left", "start")
    along = Window.partitionBy("label").orderBy(digest, "value", "left", "start")
    chosen = seen.withColumn("n", F.row_number().over(along)).filter(F.col("n") <= how.sample)
    names = list(features())
    # In one order, so that the trees are the same in every run.
    chosen = chosen.orderBy("label", "n").select(*names, "label").coalesce(1)
    chosen = store(chosen)
    if chosen.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=how.trees, maxDepth=how.depth, seed=2, featuresCol="seen", labelCol="label")
    return forest.fit(VectorAssembler(inputCols=names, outputCol="seen").transform(chosen))


def classify(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Candidates with ``chance`` of being a secret: 1 where the format settles that, 0 for placeholders, else what the forest
    says; without a model the known formats decide alone."""
    if model is None:
        return found.withColumn("chance", F.coalesce(known_format(), F.lit(0.0)))
    names = list(features())
    seen = VectorAssembler(inputCols=names, outputCol="_seen").transform(found.withColumns(features()))
    scored = model.setFeaturesCol("_seen").transform(seen)
    chance = F.when(known_format() == 1, 1.0).when(_placeholder(), 0.0).otherwise(F.element_at(vector_to_array("probability"), 2))
    return scored.withColumn("chance", chance).select(*found.columns, "chance")


def findings(documents: DataFrame, how: SecretScan = SecretScan()) -> DataFrame:
    """Classified candidates of all texts. Labelled findings are the candidates outside the held-out fold (crc32 of the doc_id
    mod 4 is 2, never learned from) which known formats settle; the others are not learned from."""
    found = store(candidates(documents))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(found.filter(~fold).withColumn("label", known_format()).filter("label is not null"), how)
    return classify(found, model).withColumn("is_secret", F.col("chance") >= how.least)


def secret_scan(documents: DataFrame, how: SecretScan = SecretScan()) -> DataFrame:
    """One row per (doc_id, text): doc_id, n_candidates, n_findings, first_start, max_chance, spans ("start-stop", comma-joined).

    ``first_start`` is null and ``spans`` empty without findings, ``max_chance`` 0 without candidates. Rows that repeat a doc_id
    and its text count as one; a null text has no candidates; an empty table gives no rows; further columns are ignored.
    """
    docs = pick(documents, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), *row_key(F.col("text")))
    found = findings(documents, how)
    span = F.when(F.col("is_secret"), F.struct("start", (F.col("start") + F.length("value")).alias("stop")))
    both = docs.select(*KEY, F.lit(0).alias("one"), F.lit(None).cast("double").alias("chance"), F.lit(None).cast("struct<start: long, stop: long>").alias("span"))
    both = both.union(found.select(*KEY, F.lit(1), "chance", span.cast("struct<start: long, stop: long>")))
    spans = F.array_sort(F.collect_set("span"))
    done = both.groupBy(*KEY).agg(F.sum("one").cast("long").alias("n_candidates"), F.max("chance").alias("max_chance"), spans.alias("s"))
    said = F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return done.select(
        "doc_id", "n_candidates", F.size("s").cast("long").alias("n_findings"), F.get("s", F.lit(0))["start"].alias("first_start"),
        F.coalesce("max_chance", F.lit(0.0)).alias("max_chance"), said.alias("spans"),
    )


def redacted(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` with every secret of ``found`` replaced by a mark; all columns and all rows stay.

    ``documents`` has the columns doc_id and text; its n_chars, where there is one, follows the text.
    """
    secrets = found.filter("is_secret").groupBy(*(F.col(k).alias(f"_{k}") for k in KEY)).agg(F.collect_set("value").alias("_secrets"))
    keys = dict(zip(("_a", "_b"), row_key(F.col("text")), strict=True))
    docs = documents.withColumns({n: c for n, c in keys.items()})
    same = docs["doc_id"].eqNullSafe(secrets["_doc_id"]) & (docs["_a"] == secrets["_key_a"]) & (docs["_b"] == secrets["_key_b"])
    joined = docs.join(secrets, same, "left")
    longest_first = F.array_sort("_secrets", lambda a, b: F.length(b) - F.length(a))
    text = F.aggregate(longest_first, F.col("text"), lambda t, s: F.replace(t, s, F.lit(REPLACEMENT)))
    out = joined.withColumn("text", F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("_secrets").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return out.select(*documents.columns)

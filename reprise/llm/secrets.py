"""Secret scan: candidate strings, and a random forest that removes false positives. DataFrame functions and Spark ML only.

Candidates are tokens of three parts, runs of 16 or more key characters, anything of 6 characters and more after a name
like `password` and a mark, and words of 10 and more characters that have every class among their first 64 (so that the
tests of one place are bounded, whatever a text's longest word). The forest sees their length, character
classes and transitions, how much of them a dictionary covers, whether they look like a path, and the words before
and after; it is trained on labelled findings(candidate, before, after, label). The dictionary is learned: the most
frequent words of all texts to be scanned, by longest match. Without findings of one's own, labelled_findings() has
generated ones, whose ordinary words come from the same dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, unstage, whole_row

KEY = "A-Za-z0-9+/_\\-"
#: Words that announce a secret, up to the mark between the two.
NAMED = "(?i:passw(?:or)?d|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
#: 6 characters or more after a name and a mark; a word of every class of characters; a token of three parts or a run of
#: key characters. All begin where no key character stands before, and what fails at most such places is asked first.
CANDIDATE = (
    f"(?<![{KEY}])(?:"
    f"(?<=[=: \"'])(?<=[=:][ \"']{{0,3}})(?<={NAMED}[\"']? {{0,2}}[=:] {{0,2}}[\"']?)[^\\s\"'`<>=]{{5,}}[^\\s\"'`<>=,.;:)]|"
    "(?=[^\\s\"'`]{10})(?<![^\\s\"'`=:(])(?=[A-Za-z0-9]*+[^A-Za-z0-9\\s])(?=[^\\s\"'`]{0,64}[0-9])(?=[^\\s\"'`]{0,64}[!#$%&*?@^~])(?=[^\\s\"'`]{0,64}[A-Z])(?=[^\\s\"'`]{0,64}[a-z])[^\\s\"'`]{9,}[^\\s\"'`,.;:)]|"
    f"eyJ[{KEY}]{{8,}}\\.[{KEY}]{{8,}}\\.[{KEY}]{{8,}}|[{KEY}]{{16,}}+)"
)
NEAR = 40
TRAINING_FINDINGS = 8_000
BLOCK = 256
#: So many words are learned: a bound on the pattern, a few tens of KB, and no limit on the texts that are counted.
DICTIONARY_WORDS = 2_048
#: Where there are no texts to learn from, and for the short made-up passwords: pieces of words in several European languages.
DICTIONARY = "tion|ment|ing|the|and|ent|ation|able|ness|ous|ive|ier|eur|eau|ais|que|ado|ido|cion|ando|ero|ung|heit|keit|lich|isch|sch|ein|ver|ber|ter|der|con|pre|pro|com|res|est|ant|ard|ist|ers|ess|all|our|ard|ight|over|ever|her|hat|tha|ere|ion|ted|ble|ly|er|an|on|re|he|in|ed|nd|ha|at|en|es|or|ti|st|th|ou|it|is|le|ei|ie|ge|ch|ue|la|de|el"
FEATURES = ["length", "digits", "marks", "upper", "lower", "hexes", "distinct", "runs", "mixes", "vowels", "covered", "slashes", "dashes", "uuid", "keyword", "assigned", "quoted", "digest", "dummy", "prefix", "pathlike"]


def learned(docs: DataFrame, size: int = DICTIONARY_WORDS) -> list[str]:
    """The `size` most frequent words of 3 to 16 letters (a to z, any case) in all of docs' texts, ties to the first in order.

    Counts are over whole texts of all rows, combined in each task before they are shuffled; only the top comes to the
    driver. Null and empty texts have no words; repeated rows count again.
    """
    words = F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit("(?<![a-z])[a-z]{3,16}+(?![a-z])"), F.lit(0))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("many"))
    return [r["word"] for r in counts.orderBy(F.desc("many"), "word").limit(size).select("word").collect()]


def longest_match(words: list[str]) -> str:
    """A pattern for the longest of the words (of 3 letters and more) at a place; they are filed by their first two letters."""
    if not words:
        return "(?!)"
    by: dict[str, dict[str, list[str]]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], {}).setdefault(w[1], []).append(w[2:])
    return "(?i:" + "|".join(a + "(?:" + "|".join(f"{b}(?:{'|'.join(rest)})" for b, rest in seconds.items()) + ")" for a, seconds in by.items()) + ")"


def features(found: DataFrame, words: str = f"(?i){DICTIONARY}") -> DataFrame:
    """The forest's inputs from candidate, before and after, with the dictionary as a pattern; nulls count as empty."""
    c, b, a = (F.coalesce(F.col(x), F.lit("")) for x in ("candidate", "before", "after"))
    n = F.greatest(F.length(c), F.lit(1))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    has = lambda x, pattern: F.regexp_like(x, F.lit(pattern)).cast("double")
    made = {
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "marks": share("[^A-Za-z0-9+/_-]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "hexes": share("[0-9a-f]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "runs": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
        "mixes": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "vowels": share("[aeiouAEIOU]"),
        "covered": 1 - F.length(F.regexp_replace(c, words, "")) / n,
        "slashes": share("/"),
        "dashes": share("[-_]"),
        "uuid": has(c, "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
        "keyword": has(b, "(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)[^ ]{0,3}\\s*[=:]?\\s*[\"']?$"),
        "assigned": has(b, "[=:]\\s*[\"']?$"),
        "quoted": has(b, "[\"']$") * has(a, "^[\"']"),
        "digest": has(b, "(?i)(sha-?[0-9]*|md5|commit|checksum|digest|revision|etag|uuid|guid|id|hash)\\W{0,4}$"),
        "dummy": has(F.concat(b, c), "(?i)(example|dummy|sample|placeholder|changeme|xxxx|your[_-]?)"),
        "prefix": has(c, "^(AKIA|ASIA|AIza|ghp_|gho_|github_pat_|sk-|sk_live_|xox[abp]-|glpat-|eyJ)"),
        "pathlike": has(F.concat(F.right(b, F.lit(10)), c), "(://|\\w/\\w+/\\w|^/\\w|\\.(com|org|net|html|py|js)/)"),
    }
    return found.withColumns({k: v.cast("double") for k, v in made.items()})


def labelled_findings(spark: SparkSession, many: int = TRAINING_FINDINGS, ordinary: list[str] | None = None) -> DataFrame:
    """Generated findings(candidate, before, after, label), half secrets, the same rows in the same order in every session.

    Ordinary words are strung together from `ordinary`, three at a time, or else from pieces, nine at a time.

    They are made once, a plan for each kind of row, and written as one small file: the forest reads that file in each of
    its passes. `many` bounds them.
    """
    i = F.col("id").cast("string")
    hexes = F.sha2(F.concat(i, F.lit("h")), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(i, F.lit("b")), 512))), "[=+]", "")
    caps = F.upper(F.translate(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(i, F.lit("c")), 512))), "[^A-Za-z2-7]", ""), "", ""))
    bit = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    pick = lambda values, salt: F.element_at(F.array(*[F.lit(v) for v in values]), (bit(len(values), salt) + 1).cast("int"))
    pieces, many_pieces = F.split(F.lit(DICTIONARY), "[|]"), DICTIONARY.count("|") + 1  # folded to one literal, where an array of literals would be one each
    syllable = lambda salt: F.element_at(pieces, (bit(many_pieces, salt) + 1).cast("int"))
    known = F.split(F.lit("|".join(ordinary)), "[|]") if ordinary else pieces
    one = lambda salt: F.element_at(known, (bit(len(ordinary) if ordinary else many_pieces, salt) + 1).cast("int"))
    word = lambda salt: F.concat_ws("", *[one(f"{salt}{j}") for j in range(3 if ordinary else 9)])
    name = one("s3") if ordinary else F.concat(syllable("s3"), syllable("s4"), syllable("s5"))
    text = pick(["the last of ", "and then ", "in der ", "pour le ", "con la ", "it was. ", "see ", "\n"], "t")
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth_token"]
    named = F.concat(text, pick(names, "n"), pick(["=", " = \"", ": \"", "='", ": ", " = "], "e"))
    closing = pick(['"', "'", "", " and", "\n"], "q")
    mixed = F.translate(F.base64(F.unhex(F.sha2(F.concat(i, F.lit("m")), 512))), "+/=aeiou", "!#@$%&*?^")
    short = F.concat(syllable("s1"), syllable("s2"), F.conv(F.substring(hexes, 1, 3), 16, 10))
    plain = ["required", "string", "something", "optional", "unknown", "expired", "changeme", "nothing", "password", "minutes", "authentication", "username/password", "everything.", "2020-01-01", "santa's", "{password}", "$PASSWORD", "undefined"]
    cut = lambda x, lo, hi, salt: F.substring(x, F.lit(1), (bit(hi - lo + 1, salt) + lo).cast("int"))
    rows = [
        (F.concat(pick(["AKIA", "ASIA"], "p"), F.substring(caps, 1, 16)), text, F.lit(" of"), 1),
        (F.concat(F.lit("AKIA"), F.substring(caps, 1, 16)), named, closing, 1),
        (cut(hexes, 16, 40, "l1"), named, closing, 1),
        (cut(hexes, 16, 64, "l2"), named, closing, 1),
        (cut(b64, 20, 64, "l3"), named, closing, 1),
        (F.concat(pick(["ghp_", "sk-", "glpat-", "AIza", "xoxb-"], "p"), F.substring(b64, 1, 36)), text, F.lit(" is"), 1),
        (cut(b64, 20, 44, "l4"), F.concat(text, F.lit("Authorization: Bearer ")), closing, 1),
        (word("w"), text, F.lit(" and"), 0),
        (F.concat(F.upper(F.substring(word("x"), 1, 1)), word("y")), F.lit(". "), F.lit(", "), 0),
        (F.substring(hexes, 1, 40), F.concat(text, pick(["commit ", "sha1: ", "revision ", "md5 = ", "checksum: ", "etag: \""], "d")), closing, 0),
        (F.concat_ws("-", *[F.substring(hexes, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.concat(text, pick(["id=", "uuid: ", "guid ", ""], "u")), closing, 0),
        (F.concat_ws("/", word("a"), word("b")), F.concat(text, pick(["http://www.", "/usr/", "path=", "see ", "/"], "h")), F.lit(".html"), 0),
        (F.rpad(F.conv(F.substring(hexes, 1, 14), 16, 10), 16, "7"), text, F.lit(". "), 0),
        (F.upper(word("v")), F.concat(F.upper(text), F.lit("!! ")), F.lit("!! "), 0),
        (F.concat(pick(["your-api-key-", "example-token-", "xxxxxxxxxxxx", "changeme-"], "z"), word("c")), named, closing, 0),
        (cut(mixed, 8, 20, "l5"), named, closing, 1),
        (cut(b64, 8, 15, "l6"), named, closing, 1),
        (short, named, closing, 1),
        (F.concat(F.lit("Aa7!"), cut(mixed, 8, 20, "l7")), text, F.lit(" "), 1),
        (F.concat(F.lit("eyJ"), F.concat_ws(".", F.substring(b64, 1, 20), F.substring(b64, 21, 30), F.substring(b64, 51, 30))), text, closing, 1),
        (pick(plain, "pl"), named, closing, 0),
        (F.concat(name, pick(["", "s", "ed", "."], "s6")), named, closing, 0),
        (F.concat(pick(["Hello,", "C++11&", "Part2:", "Q4/FY21!", "https://a.b/C?d=1&"], "f"), word("d"), pick(["", "!", "?", "#2"], "f2")), text, F.lit(" "), 0),
    ]
    kinds = spark.range(0, many, 1, 1).withColumn("kind", bit(len(rows), "kind").cast("int"))
    made = [kinds.where(F.col("kind") == k).select(c.alias("candidate"), F.right(before, F.lit(NEAR)).alias("before"), after.alias("after"), F.lit(float(label)).alias("label")) for k, (c, before, after, label) in enumerate(rows)]
    return stage(reduce(DataFrame.unionAll, made).where(F.length("candidate") >= 6).coalesce(1))


@dataclass(frozen=True)
class Judge:
    """A fitted forest and the dictionary, as a pattern, that its inputs are made with."""

    forest: PipelineModel
    words: str


def fit(findings: DataFrame, trees: int = 24, depth: int = 8, seed: int = 5, words: str = f"(?i){DICTIONARY}") -> Judge:
    """A forest on findings(candidate, before, after, label); their features are computed once and dropped with the fit."""
    forest = RandomForestClassifier(labelCol="label", featuresCol="_x", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird")
    told = stage(features(findings, words).select(*FEATURES, "label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_x"), forest]).fit(told)
    unstage(told)
    return Judge(model, words)


def trained(docs: DataFrame) -> Judge:
    """The forest on generated findings, with the words of docs as its dictionary; without any words, with the pieces."""
    if not (ordinary := learned(docs)):
        findings = labelled_findings(docs.sparkSession)
        model = fit(findings)
    else:
        findings = labelled_findings(docs.sparkSession, ordinary=ordinary)
        model = fit(findings, words=longest_match(ordinary))
    unstage(findings)
    return model


def running(parts: Column) -> Column:
    """The sums of an array of numbers up to each place, in blocks, so that long arrays are copied block by block only."""
    zero = F.lit(0).cast("long")
    many = F.ceil(F.size(parts) / BLOCK).cast("int")
    at = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda j: F.slice(parts, j * BLOCK + 1, F.lit(BLOCK))
    last = lambda s: F.element_at(s, -1)
    scan = lambda x, start: F.slice(F.aggregate(x, F.array(start), lambda s, y: F.concat(s, F.array(last(s) + y))), F.lit(2), F.size(x))
    base = F.aggregate(at, F.array(zero), lambda s, j: F.concat(s, F.array(last(s) + F.aggregate(block(j), zero, lambda t, y: t + y))))
    return F.flatten(F.transform(F.arrays_zip(at.alias("j"), F.slice(base, F.lit(1), many).alias("b")), lambda x: scan(block(x["j"]), x["b"])))


def candidates(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """Every candidate of docs' texts with the columns in keep: _at (its number, from 0), start (characters before it), candidate, before, after.

    The texts between candidates come from splitting at them, so positions and neighbours need no second search; all of
    a text's candidates are placed at once, before they become rows.
    """
    text = F.col("text").cast("string")
    found = docs.where(F.regexp_like(text, F.lit(CANDIDATE))).select(*keep, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_c"), F.split(text, CANDIDATE, -1).alias("_g"))
    names = found.columns[:-2]
    ahead = F.transform("_c", lambda x, i: (F.length(F.get("_g", i)) + F.when(i > 0, F.length(F.get("_c", i - 1))).otherwise(0)).cast("long"))
    told = found.select("*", ahead.alias("_d")).select(
        *names,
        F.arrays_zip(
            F.col("_c").alias("candidate"),
            running(F.col("_d")).alias("start"),
            F.transform("_c", lambda x, i: F.right(F.get("_g", i), F.lit(NEAR))).alias("before"),
            F.transform("_c", lambda x, i: F.left(F.get("_g", i + 1), F.lit(NEAR))).alias("after"),
        ).alias("_all"),
    )
    # outer, as the filter that a plain explode implies would search the texts once more for each use of the array
    return told.select(*names, F.posexplode_outer("_all").alias("_at", "_one")).where("_at is not null").select(*names, "_at", "_one.*")


def judged(found: DataFrame, model: Judge, threshold: float = 0.5) -> DataFrame:
    """The candidates the forest takes for secrets, with their probability."""
    scored = model.forest.transform(features(found, model.words))
    return scored.withColumn("probability", vector_to_array("probability")[1]).where(F.col("probability") >= threshold).drop("_x", "rawPrediction", "prediction", *FEATURES)


def scan(docs: DataFrame, model: Judge | None = None) -> DataFrame:
    """(doc_id, finding, start, length, kind, probability, secret_sha256) of each secret in docs(doc_id, text).

    Null and empty texts have none; repeated rows repeat their findings; other columns are ignored. The secret itself
    isn't returned. start and length count characters.
    """
    model = model or trained(docs)
    c = F.col("candidate")
    kind = F.when(c.rlike("^A[KS]IA[A-Z0-9]{16}$"), "access_key").when(F.col("before").rlike("(?i)passw|pwd"), "password").when(F.col("before").rlike("(?i)token|bearer"), "token").otherwise("key")
    out = judged(candidates(docs, [F.col("doc_id")]), model)
    return out.select("doc_id", F.col("_at").alias("finding"), "start", F.length(c).cast("long").alias("length"), kind.alias("kind"), "probability", F.sha2(c, 256).alias("secret_sha256"))


def redacted(docs: DataFrame, model: Judge | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with the secrets in `text` replaced, and n_chars made right where there is one; every row comes back once.

    Rows are told apart by (doc_id, hash of the text): equal rows are redacted alike.
    """
    model = model or trained(docs)
    text = F.col("text").cast("string")
    told = docs.select(whole_row(docs), text.alias("text"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"))
    flags = judged(candidates(told, [F.col("id"), F.col("h")]), model).groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.collect_set("_at").alias("flags"))  # of one text
    flags = stage(flags)  # few rows as a rule: then its size says so before the join is planned, and no text is shuffled
    hit = told.join(flags, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    # split only where something goes, and once: the lambda below must not do it again for every part
    cut = lambda x: F.when(F.col("flags").isNotNull(), x)
    split = hit.select("row", "text", "flags", cut(F.split("text", CANDIDATE, -1)).alias("gaps"), cut(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("found"))
    parts = F.transform("gaps", lambda g, i: F.concat(g, F.when(i >= F.size("found"), "").when(F.array_contains("flags", i), mark).otherwise(F.coalesce(F.get("found", i), F.lit("")))))
    new = split.select("row", F.col("flags").isNotNull().alias("hit"), F.when(F.col("flags").isNull(), F.col("text")).otherwise(F.array_join(parts, "")).alias("text"))
    made = {"text": F.col("text"), "n_chars": F.when(F.col("hit"), F.length("text")).otherwise(F.col("row").getField("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return new.select(*[made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in docs.columns])

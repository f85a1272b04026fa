"""Secret scanning with a random forest over findings, in DataFrame functions and Spark's own learner only.

A candidate is a value of any signs after a name that secrets have, a run that begins like a known kind of key, a long run of
key characters with a digit in it, or a shorter one that is assigned without spaces. The forest sees its length and make-up, how likely its
character transitions are in the corpus' words, how much of it dictionary words cover, its path and its neighbours, and
tells real secrets from look-alikes. It is fitted on labelled findings.
"""

import json

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import NULL_ID, SPACE, materialised, set_aside, shuffle_width
from tidemark.sources.storage import scratch_path

_KEY = r"[A-Za-z0-9+/_\-]"
#: The shortest candidate, and the shortest that is assigned without spaces: NAME=value is cut behind the sign.
SHORTEST = 16
SHORTEST_ASSIGNED = 6
_DIGIT = r"(?=[A-Za-z+/_\-]*+[0-9])"
#: Signs of equality belong to a candidate only as padding at its end.
_PADDING = r"(?:={1,2}(?![A-Za-z0-9+/=_\-]))?"
_ASSIGNED = rf"(?<={_KEY}=){_DIGIT}{_KEY}{{{SHORTEST_ASSIGNED},}}+{_PADDING}"
_LONG = rf"(?<!{_KEY}){_DIGIT}{_KEY}{{{SHORTEST},}}+{_PADDING}"
#: How keys of known kinds begin; they need no digit.
_KNOWN = rf"(?<!{_KEY})(?:(?:AKIA|ASIA)[A-Z0-9]{{12,}}+|(?i:gh[opsur]_|github_pat_|glpat-|xox[abeprs]-|sk[-_]|AIza|eyJ){_KEY}{{16,}}+{_PADDING})"
#: How names of secrets end. Lookbehinds have one width each, in Java as in Python.
_NAMED = ("token", "tokens", "secret", "secrets", "passw", "password", "passwd", "passphrase", "passcode", "pwd", "pass", "key", "key_id", "auth",
          "authorization", "credential", "credentials", "bearer", "signature")
#: Most blanks between the sign of an assignment and the value, and the shortest value.
BLANKS = 4
SHORTEST_NAMED = 6


def _after_names(quote: str, value: str) -> str:
    """The pattern of a value after a name and the sign of an assignment, and after a quote if there is one."""
    widths = sorted({len(n) for n in _NAMED})
    name = "(?:" + "|".join(f"(?<=(?i:{'|'.join(n for n in _NAMED if len(n) == w)}))" for w in widths) + ")"
    cases = []
    for blanks in range(BLANKS + 1):
        tail = f"[{SPACE}]{{{blanks}}}{quote}"
        each = [f"(?<={name}{left}{sign}{tail})" for left in ("", f"[{SPACE}\"']", f"[\"'][{SPACE}]") for sign in ("[=:]", "[:=][=>]")]
        cases.append(f"(?<=[=:>]{tail})(?:{'|'.join(each)})")
    return f"(?:{'|'.join(cases)}){value}"


_VALUES = "|".join((
    _after_names('"', rf'[^{SPACE}"]{{{SHORTEST_NAMED},}}'), _after_names("'", rf"[^{SPACE}']{{{SHORTEST_NAMED},}}"),
    _after_names("", rf"""(?!(?i:bearer|basic)[{SPACE}])[^{SPACE}"'][^{SPACE}]{{{SHORTEST_NAMED - 2},}}[^{SPACE}"',;]""")))
_BEARER = rf"""(?<=(?i:bearer)[{SPACE}])[^{SPACE}"'][^{SPACE}]{{{SHORTEST - 2},}}[^{SPACE}"',;]"""
#: The pattern of all candidates.
CANDIDATE = rf"""(?:(?<=[=:>"'{SPACE}])(?:{_VALUES}|{_BEARER})|{_KNOWN}|{_ASSIGNED}|{_LONG})"""
#: Characters kept on either side as neighbourhood.
AROUND = 80
NAMES = r"token|secret|passw|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private|signature|aws|client"
LOOKALIKES = r"commit|sha\d*|md5|checksum|digest|etag|uuid|guid|hash|revision|build|version|order|invoice|card|phone|isbn|http|href|src|image|file"
TEST_PATHS = r"(?i)(^|[/_.-])(tests?|spec|examples?|samples?|fixtures?|mocks?|docs?)([/_.-]|$)"
CONFIG_PATHS = r"(?i)([.](env|pem|key|cfg|conf|ini|ya?ml|json|properties|tfvars)$|secret|credential)"
#: Rows of documents from which labelled findings are made, and how often a word must occur to be in the dictionary.
LABELLED = 3000
COMMON = 5
TREES = 40
DEPTH = 8
MASK = "[SECRET]"
FEATURES = (
    "length digits uppers lowers signs distinct switches is_hex digits_only transitions coverage longest_word test_path config_path "
    "named lookalike assigned quoted words_before").split()


def corpus_words(texts: DataFrame) -> DataFrame:
    """(word, n): the runs of three or more ASCII letters in all texts(text), lower-cased."""
    runs = F.split(F.lower("text"), "[^a-z]+")
    return texts.select(F.explode(runs).alias("word")).filter(F.length("word") >= 3).groupBy("word").agg(F.count("*").alias("n"))


def transition_table(words: DataFrame) -> DataFrame:
    """(pair, chance): log probability of the second letter after the first over words(word, n); at most 26 * 26 rows."""
    pairs = words.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2))).alias("pair"), "n").groupBy("pair").agg(
        F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.substring("pair", 1, 1)))
    return pairs.select("pair", F.log((F.col("n") + 1) / (whole + 26)).alias("chance"))


def _between() -> Column:
    """What stands before, between and behind the candidates of text; split() would compile the pattern for every row."""
    mark = F.concat(F.lit("\0"), F.hex(F.xxhash64("text")), F.lit("\0"))
    return F.split(F.regexp_replace("text", F.lit(CANDIDATE), mark), mark, -1)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc, copy, path, start, candidate, before, after) for each candidate in docs(doc_id, text, path).

    start counts characters from 0. Rows that share doc_id, path and text give their candidates once.
    """
    cut = docs.filter(F.col("text").rlike(CANDIDATE)).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text", "path").alias("copy"), "path",
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), _between().alias("between"))
    each = cut.select("doc", "copy", "path", "between", F.posexplode("found").alias("at", "candidate")).select(
        "doc", "copy", "path", "at", "candidate", F.element_at("between", F.col("at") + 1).alias("left"),
        F.substring(F.element_at("between", F.col("at") + 2), 1, AROUND).alias("after")).withColumn(
        "before", F.substring(F.col("left"), -AROUND, AROUND)).withColumn("step", F.char_length("left").cast("long")).drop("left")
    each = each.dropDuplicates(["doc", "copy", "at"])
    order = Window.partitionBy("doc", "copy").orderBy("at")
    passed = F.sum("step").over(order) + F.coalesce(F.sum(F.char_length("candidate")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("start", passed).drop("step", "at")


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.char_length("candidate")


def described(found: DataFrame, words: DataFrame, transitions: DataFrame) -> DataFrame:
    """found(candidate, before, after, path, ...) with the columns of FEATURES."""
    runs = F.transform(F.regexp_extract_all("candidate", F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda r: F.lower(r))
    unique = found.select("candidate").distinct().withColumn("runs", runs)
    known = words.filter(F.col("n") >= COMMON).select(F.col("word").alias("run"))
    covered = unique.select("candidate", F.explode("runs").alias("run")).join(known, "run").groupBy("candidate").agg(
        F.sum(F.length("run")).alias("in_words"), F.max(F.length("run")).alias("longest_word"))
    steps = unique.select("candidate", F.explode("runs").alias("run")).select("candidate", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substring("run", i, 2))).alias("pair")).join(
        F.broadcast(transitions), "pair", "left").groupBy("candidate").agg(F.avg(F.coalesce("chance", F.lit(-8.0))).alias("transitions"))
    rows = found.join(covered, "candidate", "left").join(steps, "candidate", "left")
    size = F.char_length("candidate")
    tail = F.lower(F.substring("before", -40, 40))
    return rows.select(
        *found.columns, size.cast("double").alias("length"), _share("[0-9]").alias("digits"), _share("[A-Z]").alias("uppers"),
        _share("[a-z]").alias("lowers"), _share("[^A-Za-z0-9]").alias("signs"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / size).alias("distinct"),
        (F.regexp_count("candidate", F.lit("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]")) / size).alias("switches"),
        F.col("candidate").rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("is_hex"),
        F.col("candidate").rlike("^[0-9]+$").cast("double").alias("digits_only"),
        F.coalesce("transitions", F.lit(-8.0)).alias("transitions"),
        (F.coalesce("in_words", F.lit(0)) / size).alias("coverage"), F.coalesce("longest_word", F.lit(0)).cast("double").alias("longest_word"),
        F.coalesce(F.col("path").rlike(TEST_PATHS), F.lit(False)).cast("double").alias("test_path"),
        F.coalesce(F.col("path").rlike(CONFIG_PATHS), F.lit(False)).cast("double").alias("config_path"),
        tail.rlike(rf"({NAMES})[^{SPACE}]{{0,16}}[{SPACE}]*[=:]?[{SPACE}]*[\"']?$").cast("double").alias("named"),
        tail.rlike(rf"({LOOKALIKES})[^{SPACE}]{{0,16}}[{SPACE}]*[=:#/]?[{SPACE}]*[\"']?$").cast("double").alias("lookalike"),
        F.col("before").rlike(rf"[=:][{SPACE}]*[\"']?$").cast("double").alias("assigned"),
        (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double").alias("quoted"),
        F.size(F.array_remove(F.split(F.col("before"), f"[{SPACE}]+"), "")).cast("double").alias("words_before"))


def planted(docs: DataFrame, rows: int = LABELLED) -> DataFrame:
    """Labelled findings in text of the corpus: (doc_id, text, path, label, planted, template), one for each row and template.

    Real-looking values, derived from hashes of the row, stand in the first words of ``rows`` documents, the first by hash:
    keys under names that keys have, and identifiers, checksums, numbers and file names that are no secrets.
    """
    keyed = docs.filter(F.length("text") > 40).select(
        F.xxhash64("doc_id", "text").alias("key"), F.substring("text", 1, 400).alias("lead"), "path")
    # the ids are chosen first, so that no task gathers more than ids
    chosen = keyed.select(F.col("key").alias("_key")).distinct().orderBy("_key").limit(rows)
    base = keyed.join(F.broadcast(chosen), F.col("key") == F.col("_key")).drop("_key").dropDuplicates(["key"])
    part = F.sha2(F.concat_ws("|", F.col("key").cast("string"), F.lit("v")), 256)
    letters = F.split(F.regexp_replace(F.lower("lead"), f"[^a-z{SPACE}]+", ""), f"[{SPACE}]+")
    base = base.withColumn("part", part).withColumn("letters", letters).withColumn(
        "mixed", F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat("part", F.lit("m")), 512))), "[^A-Za-z0-9+/]", "")).withColumn(
        "upper", F.upper(F.regexp_replace("mixed", "[+/]", "Q"))).withColumn("number", F.conv(F.substring("part", 1, 13), 16, 10))
    part, mixed, upper, number = (F.col(c) for c in ("part", "mixed", "upper", "number"))
    word = [F.coalesce(F.get("letters", F.lit(i)), F.lit("name")) for i in range(3)]
    uuid = F.concat_ws("-", *[F.substring(part, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    true, false = 1, 0
    letter = F.translate(mixed, "0123456789+/", "qwxzjkvbnmyp")
    templates = [
        (true, "token = \"", F.substring(part, 1, 40), "\""), (true, "secret: ", F.substring(mixed, 1, 32), ""),
        (true, "password=", F.substring(mixed, 3, 20), ""), (true, "api_key = '", F.substring(part, 5, 32), "'"),
        (true, "AWS_ACCESS_KEY_ID=", F.concat(F.lit("AKIA"), F.substring(upper, 5, 16)), ""),
        (true, "Authorization: Bearer ", F.substring(mixed, 1, 44), ""),
        (true, "", F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(mixed, "[+/]", "x"), 1, 36)), ""),
        (true, "auth_token: \"", F.substring(part, 1, 40), "\""),
        (true, "token = \"", F.lower(F.substring(letter, 1, 26)), "\""), (true, "", F.concat(F.lit("AKIA"), F.upper(F.substring(letter, 5, 16))), ""),
        (true, "password: ", F.concat(word[0], F.substring(number, 1, 1), F.lit("!"), F.substring(part, 1, 2)), ""),
        (true, "\"passwd\": \"", F.concat(F.substring(mixed, 1, 5), F.lit("#"), F.substring(mixed, 9, 3), F.lit("$@")), "\""),
        (true, "pwd=", F.substring(mixed, 7, 9), ""),
        (false, "password: ", F.concat_ws("_", F.lit("your"), word[0], F.lit("here")), ""), (false, "token = ", F.concat(F.lit("get_"), word[0], F.lit("()")), ""),
        (false, "api_key: ", F.concat(F.lit("${"), F.upper(word[0]), F.lit("_KEY}")), ""), (false, "secret = \"", F.lit("changeme"), "\""),
        (false, "auth: ", F.concat(word[0], F.lit("-based")), ""), (false, "key: ", F.concat(word[0], word[1], F.lit("name")), ""),
        (false, "password = ", F.concat(F.lit("os.environ["), word[0], F.lit("]")), ""),
        (false, "commit ", F.substring(part, 1, 40), ""), (false, "md5 checksum: ", F.substring(part, 1, 32), ""),
        (false, "sha1=", F.substring(part, 7, 40), ""), (false, "id=", uuid, ""), (false, "page=", F.substring(number, 1, 8), ""), (false, "", F.lpad(number, 16, "4"), ""),
        (false, "card ", F.lpad(number, 16, "5"), ""), (false, "order number: ", F.lpad(number, 18, "1"), ""),
        (false, "", F.concat_ws("_", *word, F.substring(number, 1, 3)), ""),
        (false, "file = \"", F.concat_ws("/", F.lit("static/images"), *word, F.substring(number, 1, 2)), "\""),
        (false, "build ", F.concat_ws("-", word[0], word[1], F.lit("release-2024"), F.substring(number, 1, 2)), ""),
    ]
    made = base.select("key", "path", "lead", F.explode(F.array(*[
        F.struct(F.lit(k).alias("template"), F.lit(float(label)).alias("label"), F.lit(left).alias("left"), value.alias("value"), F.lit(right).alias("right"))
        for k, (label, left, value, right) in enumerate(templates)])).alias("x")).select("key", "path", "lead", "x.*")
    text = F.concat_ws(" ", F.substring("lead", 1, 80), F.concat("left", "value", "right"), F.substring("lead", 81, 80))
    case = F.pmod(F.col("key"), F.lit(7)) == 0
    return made.select(
        F.xxhash64("key", "template").alias("doc_id"), F.when(case, F.upper(text)).otherwise(text).alias("text"), "path", "label",
        F.when(case, F.upper("value")).otherwise(F.col("value")).alias("planted"), "template")


_FOREST = "array<array<struct<feature:int,threshold:double,left:int,right:int,chance:double>>>"


def fit(labelled: DataFrame) -> list[list[dict]]:
    """A forest fitted on labelled(label, *FEATURES), as plain data: the nodes of every tree, the root first.

    A leaf names no feature (-1) and has the share of secrets among its training rows. There are at most TREES trees of
    2 ** (DEPTH + 1) nodes, whatever the number of documents.
    """
    spark = labelled.sparkSession
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(labelled)
    path = scratch_path(spark, "forest")
    RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11).fit(rows).save(path)
    found = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, list[dict]] = {}
    for r in sorted(found, key=lambda r: (r["treeID"], r["id"])):
        leaf = r["leftChild"] < 0
        trees.setdefault(r["treeID"], []).append({
            "feature": -1 if leaf else r["split"]["featureIndex"], "threshold": 0.0 if leaf else r["split"]["leftCategoriesOrThreshold"][0],
            "left": r["leftChild"], "right": r["rightChild"], "chance": r["impurityStats"][1] / sum(r["impurityStats"])})
    return [trees[k] for k in sorted(trees)]


def forest_chance(forest: list[list[dict]]) -> Column:
    """The mean over all trees of the chance at the leaf that a row's FEATURES lead to; the forest is one constant of the plan."""
    trees = F.from_json(F.lit(json.dumps(forest)), _FOREST)

    def leaf(nodes: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            node = F.get(nodes, at)
            # no row has an unknown feature: all of them are numbers
            return F.when(node["feature"] < 0, at).when(F.get("_row", node["feature"]) <= node["threshold"], node["left"]).otherwise(node["right"])
        return F.get(nodes, F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), step))["chance"]
    return F.aggregate(F.transform(trees, leaf), F.lit(0.0), lambda s, x: s + x) / len(forest)


class Scanner:
    """Corpus statistics and a forest, for scanning documents(doc_id, text, path)."""

    def __init__(self, docs: DataFrame, labelled: DataFrame | None = None):
        """labelled: findings (doc_id, text, path, label, planted), the planted string being the finding; made from docs if not given."""
        docs = docs.select("doc_id", F.col("text").cast("string"), F.col("path").cast("string"))
        self.words = materialised(corpus_words(docs), "words")
        self.transitions = materialised(transition_table(self.words), "transitions")
        labelled = materialised(labelled if labelled is not None else planted(docs), "labelled")
        found = materialised(candidates(labelled), "labelled_candidates").join(
            labelled.select(F.col("doc_id").alias("doc"), "label", "planted"), "doc").filter(F.col("candidate") == F.col("planted"))
        rows = materialised(described(found, self.words, self.transitions).select("label", *FEATURES).orderBy(*FEATURES).coalesce(1), "findings")
        self.forest = fit(rows) if rows.select("label").distinct().count() > 1 else None

    def findings(self, docs: DataFrame) -> DataFrame:
        """(doc_id, copy, start, length, candidate, probability, is_secret) for every candidate in docs.

        Without labelled findings of both kinds nothing can be told apart and every candidate is a secret.
        """
        # texts are searched once, all features come from what was found
        found = materialised(candidates(docs.select("doc_id", F.col("text").cast("string"), F.col("path").cast("string"))), "candidates")
        rows = described(found, self.words, self.transitions)
        if self.forest is None:
            rows = rows.withColumn("probability", F.lit(1.0))
        else:
            # candidates are few bytes but much work each: they are dealt out again after the joins
            dealt = rows.repartition(shuffle_width(docs.sparkSession), "doc", "copy", "start")
            rows = dealt.withColumn("_row", F.array(*FEATURES)).withColumn("probability", forest_chance(self.forest))
        return rows.select(
            F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "copy", "start",
            F.char_length("candidate").cast("long").alias("length"), "candidate", F.round("probability", 9).alias("probability"),
            (F.col("probability") >= 0.5).alias("is_secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, length, candidate_sha256, probability, is_secret) for every candidate in docs(doc_id, text, path).

    A null text has no candidates, a null path says nothing, a null doc_id is kept. Rows that share doc_id, path and text are
    one document. Whole texts are read. Other columns are ignored; an empty table gives an empty result.
    """
    return Scanner(docs, labelled).findings(docs).select(
        "doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")


def masked(docs: DataFrame, path: str = "source") -> DataFrame:
    """docs with every secret in text replaced by a mask, and n_chars set anew; all rows and columns are kept."""
    docs, restore = set_aside(docs, ("doc_id", "text", "n_chars", path))
    view = docs.withColumn("_path", F.col(path)).select("doc_id", "text", F.col("_path").alias("path"))
    # written before they are joined: the plan that finds them holds the forest, the one that masks them holds the columns
    found = materialised(Scanner(view).findings(view).filter("is_secret").groupBy(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("_doc"), F.col("copy").alias("_copy")).agg(F.collect_set("candidate").alias("_secrets")), "secrets")
    some = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    keyed = docs.filter(some).withColumn("_doc_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn(
        "_copy_key", F.xxhash64("text", F.col(path).cast("string")))
    # short candidates only where they are findings, long ones wherever they stand
    covered = F.transform(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), lambda c: F.when(
        F.array_contains("_secrets", c), F.lit(MASK)).otherwise(c))
    places = F.array_join(F.zip_with(_between(), F.concat(covered, F.array(F.lit(""))), lambda t, c: F.concat(t, c)), "")
    long = F.filter(F.sort_array("_secrets", asc=False), lambda s: F.char_length(s) >= SHORTEST)
    hidden = F.aggregate(long, places, lambda t, s: F.replace(t, s, F.lit(MASK)))
    cleaned = keyed.join(found, (F.col("_doc_key") == F.col("_doc")) & (F.col("_copy_key") == F.col("_copy")), "left").withColumn(
        "text", F.when(F.col("_secrets").isNotNull(), hidden).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(F.col("_secrets").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return restore(docs.filter(~some).unionByName(cleaned.select(*docs.columns)))

"""Tables of settings applied to products, texts and vocabularies: fields that prove a constraint, category aliases, sizes in
texts, noise words, taxonomy nodes, profile requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.dialogue import _STATES, operations, session_turns
from quern.operators.lookups import VOCABULARY_SQL, vocabulary
from quern.operators.profile import TOKENS_SQL
from quern.sources.views import CATALOG_SQL, catalog, read

#: attribute, field, weight, authoritative. Fields are the text columns of a product.
FIELDS = (("color", "title", 0.8, False), ("item", "title", 0.7, False), ("item", "category", 0.5, False), ("size", "size", 1.0, True), ("size", "title", 0.6, False), ("brand", "store", 1.0, True), ("brand", "title", 0.5, False))
#: What a constraint without a hit is worth: unmet 0, pass 1, soft_unmet half the share of its tokens that the fields hold.
POLICIES = {"color": "unmet", "size": "soft_unmet", "item": "soft_unmet", "brand": "pass"}


def words_of(text: Column) -> Column:
    return F.split(text, "[^a-z0-9%]+")


def contains_term(text: Column, term: Column, words: Column | None = None) -> Column:
    """A single token matches a whole word, a phrase any substring (T29); both are lower-cased. words: words_of(text), if at hand."""
    word = F.array_contains(words_of(text) if words is None else words, term)
    return F.when(F.contains(term, F.lit(" ")), F.contains(text, term)).otherwise(word)


def constraint_hit(attribute: Column, value: Column, fields: dict[str, Column], words: dict[str, Column] | None = None) -> Column:
    """0 to 1: how well a product meets a constraint by the fields that can prove it (R14). An authoritative field that holds
    the value gives 1, else the largest weight, else the policy for missing. No value: 0.5; null fields hold nothing. words:
    words_of() the fields, if they are at hand."""
    own: dict[str, list] = {}
    for a, f, weight, authority in FIELDS:
        own.setdefault(a, []).append((f, 1.0 if authority else weight))
    worth = []
    for j in range(max(map(len, own.values()))):  # an attribute's j-th field: only its own fields are looked at
        pick = lambda of, j=j: F.coalesce(*[F.when(attribute == a, of(*fs[j])) for a, fs in own.items() if j < len(fs)])
        text, ws = pick(lambda f, w: fields[f]), pick(lambda f, w: words[f] if words else words_of(fields[f]))
        worth.append(F.when(contains_term(text, value, ws), pick(lambda f, w: F.lit(w))))
    best = F.greatest(*worth, F.lit(None).cast("double"))
    share = F.coalesce(T.token_share(F.concat_ws(" ", *fields.values()), T.constraint_tokens(value)), F.lit(0.0)) * 0.5
    policy = F.create_map(*[F.lit(x) for kv in POLICIES.items() for x in kv])[attribute]
    missing = F.when(policy == "pass", 1.0).when(policy == "unmet", 0.0).otherwise(share)
    return F.when(F.coalesce(value, F.lit("")) == "", 0.5).otherwise(F.coalesce(best, missing))


def field_constraint_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """constraint_hit() of every constraint of a session's last state against each product that the session saw; mean and
    number of full hits by product. Sessions are short, so the pairs grow with the lines.

    Pairs are read off each session's own row and counted by product, attribute and value, so that each is scored once. A
    product's words are cut once for each of its fields."""
    last = session_turns(operations(spark, sf_dir)).select(F.array_distinct(F.transform("ops", lambda o: o["asin"])).alias("asins"), F.element_at("states", -1)["cons"].alias("cons"))
    pairs = last.select("cons", F.explode("asins").alias("asin")).select("asin", F.explode("cons").alias("c")).select("asin", "c.attribute", "c.value")
    names = ("title", "size", "category", "store")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("asin"), F.lower("p_name").alias("title"), F.col("p_size").cast("string").alias("size"), F.lower("p_type").alias("category"), F.lower("p_brand").alias("store"))
    part = part.withColumn("words", F.struct(*[words_of(F.col(f)).alias(f) for f in names]))
    counted = pairs.repartition("asin").groupBy("asin", "attribute", "value").agg(F.count("*").alias("k"))  # the one shuffle of the pairs: the rest goes by product too
    hit = constraint_hit(F.col("attribute"), F.col("value"), {f: F.col(f) for f in names}, {f: F.col("words")[f] for f in names})
    scored = counted.join(part.hint("merge"), "asin").select("asin", "k", hit.alias("hit"))
    micro = F.round(F.col("hit") * 1_000_000).cast("bigint")  # whole millionths, so that the mean doesn't hang on the order of a sum
    x = scored.groupBy("asin").agg(F.sum("k").alias("n"), F.sum(F.col("k") * micro).alias("s"), F.sum(F.when(F.col("hit") >= 1, F.col("k")).otherwise(0)).alias("n_full"))
    return x.select("asin", "n", (F.expr("(2 * s + n) div (2 * n)") / 1_000_000).alias("mean_hit"), "n_full")


def _sql_hit(f: str) -> str:
    return f"CASE WHEN contains(value, ' ') THEN contains({f}, value) ELSE list_contains(string_split_regex({f}, '[^a-z0-9%]+'), value) END"


_BEST = "greatest(0.0, " + ", ".join(f"CASE WHEN attribute = '{a}' AND {_sql_hit(f)} THEN {w} ELSE 0.0 END" for a, f, w, _ in FIELDS) + ")"
_SURE = " OR ".join(f"(attribute = '{a}' AND {_sql_hit(f)})" for a, f, _, sure in FIELDS if sure)
_TOKENS = f"list_distinct(list_slice({TOKENS_SQL.format('value')}, 1, 6))"
_MISSING = " ".join(f"WHEN attribute = '{a}' THEN {'1.0' if p == 'pass' else '0.0'}" for a, p in POLICIES.items() if p != "soft_unmet")
HITS_SQL = f"""WITH RECURSIVE {_STATES}, l AS (SELECT session_id, arg_max(cons, turn) AS cons FROM states GROUP BY 1), w AS (SELECT session_id, unnest(cons, recursive := true) FROM l),
pr AS (SELECT DISTINCT session_id, asin FROM states), f AS (SELECT p_partkey AS asin, lower(p_name) AS title, p_size::VARCHAR AS size, lower(p_type) AS category, lower(p_brand) AS store FROM part),
j AS (SELECT *, {_TOKENS} AS toks FROM pr JOIN w USING (session_id) JOIN f USING (asin)),
h AS (SELECT asin, CASE WHEN value = '' THEN 0.5 WHEN {_SURE} THEN 1.0 WHEN {_BEST} > 0 THEN {_BEST} {_MISSING}
  WHEN len(toks) = 0 THEN 0.0 ELSE len(list_filter(toks, lambda t: contains(concat_ws(' ', title, size, category, store), t))) / len(toks) * 0.5 END AS hit FROM j)
SELECT asin, count(*) AS n, ((2 * sum(round(hit * 1000000)::BIGINT) + count(*)) // (2 * count(*)))::BIGINT / 1000000.0::DOUBLE AS mean_hit, count(*) FILTER (WHERE hit >= 1) AS n_full FROM h GROUP BY asin"""

#: alias, canonical; parts of a canonical are joined by underscores. The order decides.
ALIASES = (("widget", "small_widgets"), ("bolt", "fasteners_bolts"), ("ring", "rings_seals"), ("old", "vintage_parts"), ("large", "large_scale_parts"), ("gear", "gears_drives"))
MAX_EXTRA = 6


def alias_words(phrase: Column, aliases: tuple[tuple[str, str], ...] = ALIASES, most: int = MAX_EXTRA) -> Column:
    """Parts of the canonicals whose alias the phrase contains, that it doesn't hold itself, in order, at most six (J8). The
    aliases are a parameter of a few hundred at most: they become one literal array."""
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.array(*map(F.lit, c.split("_"))).alias("parts")) for a, c in aliases])
    parts = F.flatten(F.transform(F.filter(table, lambda x: F.contains(phrase, x["a"])), lambda x: x["parts"]))
    return F.slice(F.array_distinct(F.filter(parts, lambda w: ~F.contains(phrase, w))), 1, most)


def category_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the aliases in title and category add to each product's query phrase."""
    phrase = F.lower(F.concat_ws(" ", "title", "category"))
    return catalog(spark, sf_dir).select("asin", F.array_join(alias_words(phrase), " ").alias("added"))


_ALIAS_PARTS = ", ".join(f"({i}, {k}, '{a}', '{w}')" for i, (a, c) in enumerate(ALIASES) for k, w in enumerate(c.split("_")))
ALIASES_SQL = f"""WITH a(i, k, alias, word) AS (VALUES {_ALIAS_PARTS}), p AS (SELECT p_partkey AS asin, lower(concat_ws(' ', p_name, p_type)) AS phrase FROM part),
f AS (SELECT asin, word, min(i * 100 + k) AS spot FROM p JOIN a ON contains(phrase, alias) AND NOT contains(phrase, word) GROUP BY ALL),
r AS (SELECT asin, word, spot, row_number() OVER (PARTITION BY asin ORDER BY spot) AS n FROM f)
SELECT asin, coalesce((SELECT string_agg(word, ' ' ORDER BY spot) FROM r WHERE r.asin = p.asin AND n <= {MAX_EXTRA}), '') AS added FROM p"""

#: Letter sizes, size words, units of length with their signs, and the words before a number that make it a size.
LETTERS = ("xs", "s", "m", "l", "xl")
WORDS = ("small", "medium", "large")
UNITS = ("inch", "inches", "in", "cm", "mm", "ft", "feet")
SIGNS = "\"'′″”"
NAMED = ("size", "shoe size", "waist", "inseam")
#: Words that tell of a package or a part, not of a worn size.
UNWORN = ("inch", "cm", "mm", "package", "dimension", "length", "height")

#: xs to xl, more x before s and l, or a number of them; patterns are made from the tables above.
LETTER = f"(?:[2-5]xl?|x{{0,3}}[{LETTERS[1]}{LETTERS[3]}]|{LETTERS[2]})"
NUMBER = r"[0-9]{1,2}(?:\.5)?"
LENGTH = rf"(?:(?:{'|'.join(UNITS)})\b|[{SIGNS}]|[x×] ?[0-9])"


def _after(words: tuple[str, ...], what: str) -> str:
    """What follows one of the words, with a colon, an equals sign or a dash between at most."""
    return rf"(?i)\b(?:{'|'.join(words)}) ?[-:=]? ?{what}"


SIZE_FORMS = (
    ("letter", _after(("sizes?",), rf"{LETTER}\b")),
    ("letter_range", rf"(?i)\b{LETTER} ?[-/–] ?{LETTER}\b"),
    ("us_number", rf"(?i)\bus(?: size)? ?[:=-]? ?{NUMBER}\b"),
)
NUMERIC = _after(NAMED, rf"{NUMBER}\b")


def text_size(text: Column) -> Column:
    """Kind of the size that a free text names; null without one. A number that a unit of length follows is none."""
    beyond = F.regexp_extract(text, rf"(?s){NUMERIC}(.{{0,25}})", 1)
    kind = F.when(text.rlike(NUMERIC) & ~beyond.rlike(rf"(?i)^ ?{LENGTH}"), F.lit("number"))
    for name, pattern in reversed(SIZE_FORMS):
        kind = F.when(text.rlike(pattern), F.lit(name)).otherwise(kind)
    return kind


LETTER_FIELD = rf"\b{LETTER}\b|\b(?:(?:x-|extra )?(?:{'|'.join(WORDS)}))\b"
LENGTH_FIELD = rf"(?i)[0-9] ?{LENGTH}"


def structured_size(text: Column) -> Column:
    """Kind of the size in a field for sizes: letters, a number, or a number with a width; null for lengths and others."""
    low = F.lower(F.trim(text))
    length = low.rlike(LENGTH_FIELD)
    for word in UNWORN:
        length = length | F.contains(low, F.lit(word))
    return F.when(length, None).when(low.rlike(LETTER_FIELD), "letter_field").when(low.rlike(rf"^{NUMBER}$"), "number_field").when(low.rlike(rf"^{NUMBER} ?[a-z]$"), "width_field")


def size_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by field and kind of size over whole document texts and the products' size and title."""
    part = read(spark, sf_dir, "part")
    found = read(spark, sf_dir, "documents").select(F.lit("text").alias("field"), text_size(F.col("text")).alias("kind"))
    found = found.unionByName(part.select(F.lit("size").alias("field"), structured_size(F.col("p_size").cast("string")).alias("kind")))
    found = found.unionByName(part.select(F.lit("title").alias("field"), structured_size(F.col("p_name")).alias("kind")))
    return found.groupBy("field", "kind").agg(F.count("*").alias("n"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_TEXT_KIND = " ".join(f"WHEN regexp_matches(text, {_q(p)}) THEN '{n}'" for n, p in SIZE_FORMS)
_STRUCTURED = f"""CASE WHEN regexp_matches(v, {_q(LENGTH_FIELD)}) OR {" OR ".join(f"contains(v, '{w}')" for w in UNWORN)} THEN NULL WHEN regexp_matches(v, {_q(LETTER_FIELD)}) THEN 'letter_field'
  WHEN regexp_full_match(v, {_q(NUMBER)}) THEN 'number_field' WHEN regexp_full_match(v, {_q(NUMBER + " ?[a-z]")}) THEN 'width_field' END"""
SIZES_SQL = f"""WITH k AS (SELECT 'text' AS field, CASE {_TEXT_KIND} WHEN regexp_matches(text, {_q(NUMERIC)}) AND NOT regexp_matches(regexp_extract(text, {_q(NUMERIC + "(.{0,25})")}, 1, 's'), {_q("(?i)^ ?" + LENGTH)}) THEN 'number' END AS kind FROM documents
UNION ALL SELECT 'size', {_STRUCTURED} FROM (SELECT p_size::VARCHAR AS v FROM part) UNION ALL SELECT 'title', {_STRUCTURED} FROM (SELECT lower(trim(p_name)) AS v FROM part)) SELECT field, kind, count(*) AS n FROM k GROUP BY ALL"""

#: Canonicals that are noise unless something vouches for them.
NOISE = (("color", "hot"), ("color", "red"), ("size", "large"), ("style", "widget"), ("style", "unheard"))
PROTECTED_COUNT = 500


def removal_outcome(found: Column, seeded: Column, count: Column, protect: int = PROTECTED_COUNT) -> Column:
    """A noise word stays if a seed names it or very many products carry it; each outcome keeps its reason."""
    return F.when(~found, "not_found").when(seeded, "protected_seed").when(count >= protect, "protected_count").otherwise("removed")


def vocabulary_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each noise word among the title words of the catalogue."""
    noise = F.broadcast(spark.createDataFrame(list(NOISE), "attribute string, term string"))
    counts = catalog(spark, sf_dir).select(F.explode(F.array_distinct(T.tokens(F.col("title")))).alias("term")).join(noise.select("term"), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    seeds = vocabulary(spark).select("attribute", "term").distinct().withColumn("seeded", F.lit(True))
    x = noise.join(counts, "term", "left").join(seeds, ["attribute", "term"], "left")
    outcome = removal_outcome(F.col("n").isNotNull(), F.coalesce("seeded", F.lit(False)), F.col("n"))
    return x.select("attribute", "term", F.coalesce("n", F.lit(0)).alias("n_products"), outcome.alias("outcome"))


CLEANING_SQL = f"""WITH {VOCABULARY_SQL}, z(attribute, term) AS (VALUES {", ".join(map(str, NOISE))}), c AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct({TOKENS_SQL.format("p_name")})) AS term FROM part) GROUP BY 1)
SELECT z.attribute, z.term, coalesce(n, 0) AS n_products, CASE WHEN n IS NULL THEN 'not_found' WHEN (z.attribute, z.term) IN (SELECT (attribute, term) FROM vocab) THEN 'protected_seed' WHEN n >= {PROTECTED_COUNT} THEN 'protected_count' ELSE 'removed' END AS outcome
FROM z LEFT JOIN c USING (term)"""

#: node, canonical, priority (larger wins over depth); a null canonical marks noise.
NODES = (("parts", None, 0), ("standard", "regular_line", 1), ("economy", "budget_line", 1), ("promo", "budget_line", 1), ("large", "big_line", 2), ("small", "mini_line", 2))


def map_taxonomy(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """canonical, outcome (mapped, noise, unmapped) and weight of paths (A17): the node of the largest priority decides, the
    last one of equals; a path whose known nodes are all noise is noise. paths: path array<string>, weight; nodes: node,
    canonical, priority, a settings table. Equal paths are summed first, so what is exploded grows with distinct paths."""
    p = paths.groupBy("path").agg(F.sum("weight").alias("weight")).withColumn("id", F.sha2(F.to_json(F.struct("path")), 256))
    each = p.select("id", "weight", F.posexplode_outer(F.transform("path", T.slug)).alias("pos", "node"))
    best = F.max_by("canonical", F.when(F.col("canonical").isNotNull(), F.struct("priority", "pos")))
    got = each.join(nodes.withColumn("known", F.lit(True)), "node", "left").groupBy("id", "weight").agg(best.alias("canonical"), F.max("known").alias("known"))
    outcome = F.when(F.col("canonical").isNotNull(), "mapped").when(F.col("known"), "noise").otherwise("unmapped")
    return got.groupBy("canonical", outcome.alias("outcome")).agg(F.sum("weight").alias("weight"))


def taxonomy_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product weight by canonical line over the products' whole paths, brand and title words last, with what stays unmapped."""
    path = F.concat("categories", F.array("store"), F.split("title", " "))
    return map_taxonomy(catalog(spark, sf_dir).select(path.alias("path"), F.lit(1).alias("weight")), spark.createDataFrame(list(NODES), "node string, canonical string, priority int"))


TAXONOMY_SQL = f"""WITH {CATALOG_SQL}, k(node, canonical, priority) AS (VALUES {", ".join(f"('{n}', {repr(c) if c else 'NULL'}, {p})" for n, c, p in NODES)}),
p AS (SELECT asin, list_concat(list_append(categories, store), string_split(title, ' ')) AS path FROM catalog), e AS (SELECT asin, lower(unnest(path)) AS node, generate_subscripts(path, 1) AS pos FROM p),
b AS (SELECT asin, arg_max(canonical, priority * 1000 + pos) FILTER (WHERE canonical IS NOT NULL) AS canonical, bool_or(k.node IS NOT NULL) AS known FROM e LEFT JOIN k USING (node) GROUP BY 1)
SELECT canonical, CASE WHEN canonical IS NOT NULL THEN 'mapped' WHEN known THEN 'noise' ELSE 'unmapped' END AS outcome, count(*) AS weight FROM b GROUP BY ALL"""


def unknown_configs(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows whose config_id no profile has."""
    return rows.join(profiles, "config_id", "left_anti")


def requirements_met(needs: Column, capable: dict[str, bool]) -> Column:
    """A profile's map of required capabilities asks for nothing that isn't there; a null map asks for nothing."""
    lacking = F.array(*[F.lit(k) for k, v in capable.items() if not v]).cast("array<string>")
    return F.coalesce(~F.exists(lacking, lambda k: F.coalesce(needs[k], F.lit(False))), F.lit(True))


def fold_of(target: Column, folds: int, seed: int = 7) -> Column:
    """Fold of a target by its seeded hash: rows of one target share a fold (E3), and no driver or single task deals them."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), target.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(folds)).cast("int")


def nested_selection(spark: SparkSession, sf_dir: str, folds: int = 5) -> DataFrame:
    """For each outer fold the configuration (event type) chosen by mean over the other folds, the last name of equals, and its
    mean in the fold that was left out (E3, E7). Training sums are totals less the fold's own, so rows are read once."""
    e = read(spark, sf_dir, "events").select(fold_of(F.col("user_id"), folds).alias("fold"), F.col("event_type").alias("config"), "value")
    own = e.groupBy("fold", "config").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    rest = own.join(own.groupBy("config").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn")), "config").withColumn("train", F.round((F.col("ts") - F.col("s")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0)), 9))
    best = rest.groupBy("fold").agg(F.max_by(F.struct("config", "train", (F.col("s") / F.nullif("n", F.lit(0))).alias("test")), F.struct("train", "config")).alias("b"))
    return best.select("fold", "b.config", F.round("b.train", 6).alias("train"), F.round("b.test", 6).alias("test"))


NESTED_SQL = """WITH e AS (SELECT ('0x' || substr(md5('7:' || user_id), 1, 8))::BIGINT % 5 AS fold, event_type AS config, value FROM events), o AS (SELECT fold, config, sum(value) AS s, count(value) AS n FROM e GROUP BY ALL),
r AS (SELECT *, round((sum(s) OVER (PARTITION BY config) - s) / (sum(n) OVER (PARTITION BY config) - n), 9) AS train FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train DESC, config DESC) AS i FROM r)
SELECT fold::INT AS fold, config, round(train, 6) AS train, round(s / n, 6) AS test FROM k WHERE i = 1"""

QUERIES = {f.__name__: f for f in (field_constraint_hits, category_aliases, size_kinds, vocabulary_cleaning, taxonomy_mapping, nested_selection)}
SQL = dict(zip(QUERIES, (HITS_SQL, ALIASES_SQL, SIZES_SQL, CLEANING_SQL, TAXONOMY_SQL, NESTED_SQL), strict=True))

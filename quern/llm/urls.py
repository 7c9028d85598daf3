"""URL filters by empirical-Bayes host reputation: DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host. A chain of beta-binomial priors shrinks the rates: corpus to
public suffix, suffix to registered domain, domain to host. The strength of each prior comes from the data (method of
moments on the dispersion of the children's rates); a host without labels takes its domain's posterior, a domain without
labels its suffix's. A page is blocked when the probability, under its host's beta posterior, that the bad rate is at most
the threshold is under TAIL: that is, when the posterior's lower TAIL quantile is above the threshold. An explicit
rule, the longest that fits, wins over the reputation.

For the levels, user information, a port and a dot at the end are taken off the host. A suffix is the last label, or the
last two where they are in SECOND_LEVEL (a short list of registries that sell third-level names; others count as
domains of their own); the domain is the suffix and the label before it. IP addresses are their own suffix and domain.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is judged as the host "" is;
outcomes that are null or whose page is missing count for nothing; several labels of one page count one by one; without
any label every rate is 0 and everything without a rule is allowed; an empty table gives an empty result. Columns other
than those named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): the rule is a host, with a path from its first slash on.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Probability left under the bound, the bad rate that the bound must exceed, and the number of points of the quadrature.
TAIL, THRESHOLD, POINTS = 0.05, 0.5, 400
#: Suffixes of two labels, as registries use them.
SECOND_LEVEL = (
    "co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "net.uk", "com.au", "net.au", "org.au", "edu.au", "co.nz", "org.nz", "co.za", "org.za",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "or.kr", "co.in", "org.in", "com.br", "org.br", "com.cn", "net.cn", "org.cn", "com.tw",
    "com.hk", "com.sg", "com.my", "com.mx", "com.ar", "com.co", "com.pe", "com.tr", "com.ua", "com.pl", "co.il", "com.eg", "com.sa", "com.ng",
)
#: Limits of the estimated intra-class correlation of a level, so that priors neither vanish nor freeze.
RHO = (0.001, 0.5)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_ADDRESS = r"^\d{1,3}(\.\d{1,3}){3}$|[\[\]:]"


def name_of(host: Column) -> Column:
    """The host without user information, port and a dot at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", ""), r"\.$", "")


def suffix_of(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_ADDRESS), name).when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(_ADDRESS), name).when(two.isin(*SECOND_LEVEL), F.substring_index(name, ".", -3)).otherwise(two)


def beta_below(a: Column, b: Column, x: float, points: int | None = None) -> Column:
    """P(rate <= x) under Beta(a, b): the density summed over POINTS midpoints in the square root's angle, which smooths
    both ends. Its logarithm at the mode, known in closed form, is taken off, so that nothing overflows; each point is made
    once, and one fold adds up both sums."""
    points = points or POINTS
    angle = lambda i: (i - 0.5) * (math.pi / 2 / points)
    # rate = sin(angle)^2, so the density in the angle is sin^(2a-1) cos^(2b-1)
    log = lambda sin, cos: (2 * a - 1) * F.log(sin) + (2 * b - 1) * F.log(cos)
    first, last = math.sin(angle(1)) ** 2, math.sin(angle(points)) ** 2
    mode = F.when((a > 0.5) & (b > 0.5), F.greatest(F.lit(first), F.least(F.lit(last), (2 * a - 1) / (2 * a + 2 * b - 2)))).when(a < b, first).otherwise(last)
    top = log(F.sqrt(mode), F.sqrt(1 - mode))
    below = sum(1 for i in range(1, points + 1) if math.sin(angle(i)) ** 2 <= x)
    made = F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: F.struct(i.alias("i"), F.exp(log(F.sin(angle(i)), F.cos(angle(i))) - top).alias("p")))
    none = F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("all"))
    add = lambda acc, v: F.struct((acc["below"] + F.when(v["i"] <= below, v["p"]).otherwise(0.0)).alias("below"), (acc["all"] + v["p"]).alias("all"))
    return F.aggregate(made, none, add, lambda acc: acc["below"] / acc["all"])


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null: none) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame) -> float:
    """Prior strength m = 1 / rho - 1 from (n, k, p): counts of the children and the mean of their parent."""
    v = F.col("p") * (1 - F.col("p"))
    s = children.filter("p > 0 and p < 1").agg(
        F.count("*").alias("i"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("p")) * (F.col("k") / F.col("n") - F.col("p")) / v).alias("s"),
    ).first()  # one row
    if not s["i"] or s["i"] < 2 or s["n"] - s["n2"] / s["n"] - (s["i"] - 1) <= 0:
        rho = RHO[0]
    else:
        rho = (s["s"] - (s["i"] - 1)) / (s["n"] - s["n2"] / s["n"] - (s["i"] - 1))
    return 1 / min(max(rho, RHO[0]), RHO[1]) - 1


def _shrunk(n: Column, k: Column, parent: Column, m: float) -> Column:
    return (F.coalesce(k, F.lit(0)) + F.lit(m) * parent) / (F.coalesce(n, F.lit(0)) + F.lit(m))


def reputation(hosts: DataFrame, labelled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """host, n, k, rate (posterior mean) and below (probability that the rate is at most threshold) of every host.

    labelled has one row for each labelled outcome: host, bad (0 or 1). Everything past the first aggregation works on
    one row a host, domain or suffix; only single rows of totals reach the driver."""
    seen = labelled.filter("bad is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("k"))
    name = name_of(F.col("host"))
    seen = staged(seen.withColumn("domain", domain_of(name)).withColumn("suffix", suffix_of(name)), "hosts")
    domains = seen.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = float((total["k"] or 0) / total["n"]) if total["n"] else 0.0
    m_suffix = _strength(suffixes.withColumn("p", F.lit(base)))
    suffixes = suffixes.select("suffix", _shrunk(F.col("n"), F.col("k"), F.lit(base), m_suffix).alias("p_suffix"))
    up = domains.join(suffixes, "suffix")
    m_domain = _strength(up.withColumn("p", F.col("p_suffix")))
    domains = up.select("domain", _shrunk(F.col("n"), F.col("k"), F.col("p_suffix"), m_domain).alias("p_domain"))
    up = seen.join(domains, "domain")
    m_host = _strength(up.withColumn("p", F.col("p_domain")))

    every = hosts.select("host").distinct().withColumn("domain", domain_of(name)).withColumn("suffix", suffix_of(name))
    wide = every.join(seen.select("host", "n", "k"), "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    parent = F.coalesce("p_domain", "p_suffix", F.lit(base))
    n = F.coalesce("n", F.lit(0.0))
    rate = _shrunk(F.col("n"), F.col("k"), parent, m_host)
    out = wide.select("host", n.alias("n"), F.coalesce("k", F.lit(0.0)).alias("k"), rate.alias("rate"))
    weight = F.col("n") + F.lit(m_host)  # the posterior is Beta(rate * weight, (1 - rate) * weight); a rate of 0 or 1 is sure
    below = F.when(F.col("rate") <= 0, 1.0).when(F.col("rate") >= 1, 0.0).otherwise(beta_below(F.col("rate") * weight, (1 - F.col("rate")) * weight, threshold))
    return out.withColumn("below", below)


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """id, host, path, rule, verdict, bad_rate, p_below. outcomes: id_col and bad (0 or 1)."""
    slim = staged(pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")), "urls")
    labelled = slim.join(outcomes.select(F.col(id_col).alias("_id"), "bad"), "_id").select("host", "bad")
    known = reputation(slim, labelled, threshold).select(F.col("host").alias("_host"), F.col("rate").alias("bad_rate"), F.col("below").alias("p_below"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("p_below") < TAIL, F.lit("block")).otherwise(F.lit("allow"))
    joined = slim.join(known, slim["host"] == known["_host"], "left")
    return joined.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "bad_rate", "p_below")


def outcomes_of(labels: DataFrame) -> DataFrame:
    """A page takes the label of the document of its id: bad if of low quality or toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad"))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), outcomes_of(table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"))


def _sql_strength(rows: str) -> str:
    core = f"SELECT count(*) AS i, sum(n) AS n, sum(n * n) AS n2, sum(n * (k / n - p) * (k / n - p) / (p * (1 - p))) AS s FROM {rows} WHERE p > 0 AND p < 1"
    rho = f"CASE WHEN coalesce(i, 0) < 2 OR n - n2 / n - (i - 1) <= 0 THEN {RHO[0]} ELSE (s - (i - 1)) / (n - n2 / n - (i - 1)) END"
    return f"SELECT 1 / least(greatest({rho}, {RHO[0]}), {RHO[1]}) - 1 AS m FROM ({core})"


OP6_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
nm AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', ''), '\.$', '') AS name FROM u),
lb AS (SELECT *, regexp_matches(name, '{_ADDRESS}') AS address, array_to_string(string_split(name, '.')[-2:], '.') AS two, array_to_string(string_split(name, '.')[-3:], '.') AS three FROM nm),
hs AS (SELECT page_id, host, path, CASE WHEN address THEN name WHEN two IN {SECOND_LEVEL} THEN three ELSE two END AS domain,
       CASE WHEN address THEN name WHEN two IN {SECOND_LEVEL} THEN two ELSE string_split(name, '.')[-1] END AS suffix FROM lb),
o AS (SELECT host, domain, suffix, CASE WHEN quality = 0 OR toxic = 1 THEN 1.0 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0.0 END AS bad FROM hs JOIN labels ON doc_id = page_id),
h1 AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k FROM o WHERE bad IS NOT NULL GROUP BY ALL),
d1 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h1 GROUP BY ALL),
s1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d1 GROUP BY ALL),
b AS (SELECT coalesce(sum(k) / sum(n), 0.0) AS base FROM s1),
s2 AS (SELECT s1.*, base AS p FROM s1, b), sm AS ({_sql_strength("s2")}),
s3 AS (SELECT suffix, (k + m * p) / (n + m) AS ps FROM s2, sm),
d2 AS (SELECT d1.*, ps AS p FROM d1 JOIN s3 USING (suffix)), dm AS ({_sql_strength("d2")}),
d3 AS (SELECT domain, (k + m * p) / (n + m) AS pd FROM d2, dm),
h2 AS (SELECT h1.*, pd AS p FROM h1 JOIN d3 USING (domain)), hm AS ({_sql_strength("h2")}),
r AS (SELECT hs.page_id, hs.host, hs.path, (coalesce(h1.k, 0) + m * coalesce(pd, ps, base)) / (coalesce(h1.n, 0) + m) AS rate, coalesce(h1.n, 0) + m AS w
      FROM hs LEFT JOIN h1 ON h1.host = hs.host LEFT JOIN d3 ON d3.domain = hs.domain LEFT JOIN s3 ON s3.suffix = hs.suffix, hm, b),
f AS (SELECT *, CASE {" ".join(f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{t}'" for _, t in sorted(RULES, key=lambda r: -len(r[1])))} END AS rule FROM r),
hw AS (SELECT DISTINCT rate, w FROM f WHERE rate > 0 AND rate < 1),
q AS (SELECT rate, w, i, (2 * rate * w - 1) * ln(sin((i - 0.5) * pi() / {2 * POINTS})) + (2 * (1 - rate) * w - 1) * ln(cos((i - 0.5) * pi() / {2 * POINTS})) AS v FROM hw, range(1, {POINTS + 1}) AS t(i)),
qm AS (SELECT *, max(v) OVER (PARTITION BY rate, w) AS top FROM q),
pb AS (SELECT rate, w, sum(exp(v - top)) FILTER (pow(sin((i - 0.5) * pi() / {2 * POINTS}), 2) <= {THRESHOLD}) / sum(exp(v - top)) AS below FROM qm GROUP BY rate, w)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{t}' THEN '{v}'" for v, t in RULES)} WHEN below < {TAIL} THEN 'block' ELSE 'allow' END AS verdict,
       round(rate, 6) AS bad_rate
FROM f LEFT JOIN pb USING (rate, w)
"""

"""URL rules: host and path rules with exceptions, and pattern rules found through an index of literal tokens.

A rule is a host with a path prefix (allow or block) or a pattern: a regular expression with the literal tokens any matching
URL must have. Each rule is indexed under the one of its tokens that is rarest among the URLs judged, so a token that nearly
all URLs share fetches next to nothing. The tokens of a URL fetch candidate rules, and only candidates are run. For host
rules the literal tokens are the labels of the host and the whole segments of the path.

Of the host rules that fit, the longest wins and gives the verdict; where none fits, a fitting pattern rule blocks, and all
else is allowed. A host rule fits its host and every subdomain of it, if the path starts with the rule's path. Host: after
the first "://" up to "/", "?", "#" or the end, with A-Z in lower case; path: from there up to "?", "#" or the end. Null URLs
and those without "://" have an empty host and path, fit no rule and are allowed. URLs of any length are read whole. All rows
pass, equal ones with equal results, and so do all other columns, null or not, under any name; columns named as a result (host,
path, rule, pattern, verdict) are replaced. An empty table gives an empty one.

Expressions run over host and path with "#" between them, which neither can hold. The rules are a parameter held in the plan;
with more than MAX_INLINE of them the same lookup runs as a join on the token. A rule without a token would be a candidate
for every URL; the rules of the query all have one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from .common import quoted, same, table, unused

#: Rules that may be held in the plan itself, as a map from token to rules.
MAX_INLINE = 200


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> list[str]:
        whole = self.path.split("/")[1:-1]  # the last segment may be a mere beginning
        return sorted({t for t in self.host.split(".") + whole if t})

    @property
    def pattern(self) -> str:
        """Over "host#path": the host or a subdomain of it, and the beginning of the path."""
        return rf"^(?:[^#]*\.)?{literal(self.host)}#{literal(self.path)}"


def literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over "host#path"; `needs` are tokens of every text it matches."""

    name: str
    pattern: str
    needs: tuple[str, ...]
    verdict: str = "block"

    @property
    def tokens(self) -> list[str]:
        return sorted(set(self.needs))


def host_words(*words: str) -> PatternRule:
    """The words next to each other in the host, with a sign before, between and after them."""
    sign = r"[^#\p{L}\p{N}]"
    return PatternRule("-".join(words), rf"^(?:[^#]*{sign})?{(sign + '+').join(words)}(?:{sign}|#)", words)


def path_words(*words: str) -> PatternRule:
    """The words, joined by a sign, as the beginning of a path segment."""
    return PatternRule("/" + "-".join(words), rf"#[^#]*/{'[-_+.]'.join(words)}(?:[^\p{{L}}\p{{N}}]|$)", words)


#: The rules of the query: those of its contract, then words of hosts that sell or spam and of paths without text of their own.
HOST_RULES = (
    HostRule("allow", "org"), HostRule("block", "example.org", "/es/"), HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"), HostRule("block", "com", "/de/"),
)
PATTERN_RULES = (
    *map(host_words, "casino casinos poker bets betting gambling slots lottery jackpot bingo".split()),
    *map(host_words, "pills viagra cialis xanax tramadol steroids".split()),
    *map(host_words, "adult porn porno xxx hentai escorts camgirls nudes".split()),
    *map(host_words, "spam malware phishing warez cracked keygen torrents adserver adservice popunder doubleclick clickbait".split()),
    PatternRule("cheap-goods", r"^(?:[^#]*[^#\p{L}\p{N}])?cheap-[^#]", ("cheap",)),
    host_words("payday", "loans"), host_words("payday", "loan"), host_words("replica", "watches"), host_words("free", "download"), host_words("free", "downloads"), host_words("get", "rich"),
    path_words("free", "download"), path_words("wp", "login"), path_words("wp", "admin"), path_words("cgi", "bin"),
    *map(path_words, "login signin signup logout checkout unsubscribe".split()),
)


def host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, F.lit("://"))
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    rest = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.substring_index(rest, "/", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, F.substring(rest, F.length(host) + 1, F.length(rest))


def tokens(host: Column, path: Column) -> Column:
    """Distinct literal tokens: host labels and path segments, and their parts between other signs."""
    text = F.concat_ws("/", F.translate(host, ".", "/"), path)
    return F.array_distinct(F.filter(F.concat(F.split(text, "/"), F.split(text, r"[^\p{L}\p{N}]+")), lambda t: t != ""))


def index(rules: list, frequency: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Token -> rules filed under it (each under its rarest), and the rules without a token, which are always candidates."""
    by: dict[str, list[int]] = {}
    loose = []
    for i, r in enumerate(rules):
        if r.tokens:
            by.setdefault(min(r.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(i)
        else:
            loose.append(i)
    return by, loose


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many URLs have each of the rules' tokens: counted over all URLs, as sums of flags, or by a join for many rules."""
    if not wanted:
        return {}
    if len(wanted) <= MAX_INLINE:
        hit = urls.select(F.explode(F.array_intersect(F.col("__t"), F.array(*map(F.lit, wanted)))).alias("t"))
    else:
        w = urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
        hit = urls.select(F.explode("__t").alias("t")).join(w, "t", "left_semi")
    return {r["t"]: r["n"] for r in hit.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def judge(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, url_col: str = "url", max_inline: int = MAX_INLINE) -> DataFrame:
    """All rows and columns with host, path, rule (of the host rule that won, else null), pattern (first that fits) and verdict."""
    host, path = host_path(F.col(url_col))
    rows = pages.drop("host", "path", "rule", "pattern", "verdict").withColumns({"host": host, "path": path})
    keep = same(rows)
    t, u, c, b, p, w, h = unused(rows, *"__tokens __url __rules __best __pattern __id __host".split())
    rows = rows.withColumns({t: tokens(F.col("host"), F.col("path")), u: F.concat_ws("#", "host", "path")})
    rules = sorted(host_rules, key=lambda r: (-len(r.name), r.name)) + list(pattern_rules)
    n_host = len(host_rules)
    wanted = sorted({t for r in rules for t in r.tokens})
    by, loose = index(rules, token_counts(rows.select(F.col(t).alias("__t")), wanted))
    spark = pages.sparkSession
    if len(rules) <= max_inline:
        run = lambda i: F.rlike(F.col(u), F.lit(rules[i].pattern))
        filed = F.create_map(*[x for k, v in by.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if by else None
        fetched = F.flatten(F.transform(F.array_intersect(F.col(t), F.array(*map(F.lit, by))), lambda x: F.element_at(filed, x))) if by else F.array().cast("array<int>")
        rows = rows.withColumn(c, F.array_distinct(F.concat(fetched, F.array(*map(F.lit, loose)).cast("array<int>"))))
        fits = [F.when(F.array_contains(c, i) & run(i), F.lit(i)) for i in range(len(rules))]
        best = F.coalesce(*fits[:n_host]) if n_host else F.lit(None).cast("int")
        pat = F.coalesce(*fits[n_host:]) if len(fits) > n_host else F.lit(None).cast("int")
        rows = rows.withColumns({b: best, p: pat})
        # of the rule that fits, by its number
        of = lambda col, what: F.when(F.col(col) >= 0, F.element_at(F.array(*[F.lit(getattr(r, what)) for r in rules]), F.col(col) + 1)) if rules else F.lit(None).cast("string")
        return rows.select(*keep, of(b, "name").alias("rule"), of(p, "name").alias("pattern"), F.coalesce(of(b, "verdict"), of(p, "verdict"), F.lit("allow")).alias("verdict"))
    # many rules: token -> rule as a table; the planner broadcasts it if it is small, and splits frequent tokens if not
    filed = [(k, i) for k, v in by.items() for i in v] + [("", i) for i in loose]
    index_rows = spark.createDataFrame([(k, i, i < n_host, rules[i].name, rules[i].pattern, rules[i].verdict) for k, i in filed], "t string, i int, hosted boolean, name string, pattern string, verdict string")
    rows = table(rows.withColumn(w, F.monotonically_increasing_id()), "urls")  # written, as the numbers must stay the same
    cand = rows.select(F.col(w).alias("w"), F.col(u).alias("u"), F.explode(F.concat(F.col(t), F.array(F.lit("")))).alias("t")).join(index_rows, "t").filter(F.expr("u rlike pattern"))
    one = F.struct("i", "name", "verdict")
    won = cand.groupBy("w").agg(F.min(F.when(F.col("hosted"), one)).alias(h), F.min(F.when(~F.col("hosted"), one)).alias(p)).withColumnRenamed("w", b)
    return rows.join(won, F.col(w) == F.col(b), "left").select(
        *keep, F.col(f"{h}.name").alias("rule"), F.col(f"{p}.name").alias("pattern"), F.coalesce(f"{h}.verdict", f"{p}.verdict", F.lit("allow")).alias("verdict")
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op8_url_filter": op8_url_filter}
_HOST = lambda h: f"(host = '{h}' OR ends_with(host, '.{h}'))"
ORACLE = {
    "op8_url_filter": rf"""WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM a),
c AS (SELECT *, CASE WHEN {_HOST('example.org')} AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN {_HOST('example.org')} AND starts_with(path, '/es/') THEN 'example.org/es/'
WHEN {_HOST('com')} AND starts_with(path, '/de/') THEN 'com/de/' WHEN {_HOST('com')} AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN {_HOST('org')} AND starts_with(path, '/') THEN 'org/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
WHEN {" OR ".join(f"regexp_matches(host || '#' || path, '{r.pattern}')" for r in PATTERN_RULES)} THEN 'block' ELSE 'allow' END AS verdict FROM c"""
}

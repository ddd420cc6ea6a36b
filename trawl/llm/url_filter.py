"""URL filters: pattern rules indexed by their rarest literal token.

Every rule compiles to one regular expression over ``host + rest`` of a URL and
to the literal tokens that any matching URL must contain. A rule is filed under
the one of its tokens that the fewest URLs hold; a URL fetches only the rules
filed under its own tokens, and only those run their regular expression.
Everything is DataFrame work; URLs are judged once per distinct value, so hot
URLs cost one row after the map-side combine.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import ascii_lower

#: The rule index is broadcast up to this many bytes and joined by shuffle beyond.
BROADCAST_BYTES = 8 << 20
#: Copies of each rule in the shuffled index, over which a hot token's URLs are dealt.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; of the fitting rules the highest ``priority`` wins, then the smaller name.

    ``regex`` is searched in the lower-cased host followed by the rest of the
    URL; ``tokens`` are runs of [a-z0-9] that stand between other characters
    (or ends) in every URL that fits, or () when none is certain.
    """

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    priority: int


def host_path_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: fits the host and its subdomains when the path starts with the rule's; longer rules win."""
    host, slash, path = rule.partition("/")
    path = slash + path
    regex = rf"^([^/?#]*\.)?{_quote(host.lower())}{_quote(path)}"
    # The last run of the path may go on in the URL; the others are bounded.
    tokens = re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(rule, verdict, regex, tuple(dict.fromkeys(tokens)), 1_000_000 + len(rule))


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """Filter-list syntax without options: ``*`` is any text, ``^`` a separator or the end, a leading ``||`` a
    domain boundary, ``|`` at an end anchors there. Matching ignores ASCII case. Ranks below host/path rules."""
    body, head, tail = pattern.lower(), "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^([^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    parts = {"*": ".*", "^": r"([^a-z0-9_.%-]|$)"}
    regex = "(?is)" + head + "".join(parts.get(c) or _quote(c) for c in body) + tail
    tokens = []
    for m in re.finditer("[a-z0-9]+", body):
        before = body[m.start() - 1] if m.start() else head and "^"
        after = body[m.end()] if m.end() < len(body) else tail
        if before and before != "*" and after and after != "*":
            tokens.append(m.group())
    return Rule(pattern, verdict, regex, tuple(dict.fromkeys(tokens)), len(pattern))


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/\x80-\U0010ffff])", r"\\\1", text)


#: Used for URLs that no host/path rule covers: advertising, tracking, adult and shop-cart addresses.
DEFAULT_PATTERNS = (
    ("block", "||doubleclick.net^"), ("block", "||adservice.*^"), ("block", "/adserver/"), ("block", "/banner/ads/"),
    ("block", "/wp-login.php"), ("block", "/cart/checkout"), ("block", "||xxx.*^"), ("block", "/porn/"),
    ("block", "/casino/"), ("block", "?affiliate_id="), ("allow", "||archive.org^"),
)


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest): host after the first ``://`` with A-Z lower-cased, path up to ``?`` or ``#``, rest whole.

    All three are empty for null and for URLs without ``://``.
    """
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3))
    after = F.coalesce(after, F.lit(""))
    host = ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0))
    rest = F.substr(after, F.length(F.regexp_extract(after, r"^[^/?#]*", 0)) + 1)
    return host, F.regexp_extract(rest, r"^[^?#]*", 0), rest


def judge_urls(
    df: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``df`` with host, path, rule and verdict appended (``url_host`` ... when such names exist already).

    One row out per row in, repeated rows included. A null URL or one without
    ``://`` has empty host and path and gets ``default`` unless a rule without
    literals fits the empty text. Of several fitting rules the highest priority
    wins, ties by name. Empty tables and empty rule lists give no error.
    """
    spark = df.sparkSession
    names = [n if n not in {c.lower() for c in df.columns} else f"url_{n}" for n in ("host", "path", "rule", "verdict")]
    host, path, rest = split_url(F.col(url_col))
    urls = df.select(F.col(url_col).alias("_u")).distinct().where(F.col("_u").isNotNull())
    h, _, r = split_url(F.col("_u"))
    urls = urls.select("_u", F.concat(h, r).alias("_s"))
    tokens = F.array_union(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("_s")), F.lit("([a-z0-9]+)"), F.lit(1))), F.array(F.lit("")))
    exploded = urls.select("_u", "_s", F.explode(tokens).alias("_t"))

    fields = "rid int, token string"
    by_token = spark.createDataFrame([(i, t) for i, x in enumerate(rules) for t in (x.tokens or ("",))], fields)
    table = spark.createDataFrame(
        [(i, x.name, x.verdict, x.regex, x.priority) for i, x in enumerate(rules)],
        "rid int, name string, verdict string, regex string, priority int",
    )
    size = sum(len(x.name) + len(x.regex) + 200 for x in rules)
    hint = F.broadcast if size <= broadcast_bytes else (lambda x: x)
    wanted = hint(by_token.select("token").distinct())
    # How many URLs hold each token of a rule: one row per token after the map-side combine.
    held = exploded.join(wanted, exploded["_t"] == wanted["token"], "left_semi").groupBy("_t").count()
    ranked = by_token.join(held, by_token["token"] == held["_t"], "left").groupBy("rid").agg(
        F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), F.col("token"))).alias("token")
    )
    index = table.join(ranked, "rid")
    if size <= broadcast_bytes:
        hits = exploded.join(F.broadcast(index), exploded["_t"] == index["token"])
    else:
        salted = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = exploded.withColumn("_salt", F.pmod(F.xxhash64("_u"), F.lit(SALTS)).cast("int"))
        hits = dealt.join(salted, (dealt["_t"] == salted["token"]) & (dealt["_salt"] == salted["_salt"]))
    best = hits.where(F.expr("_s rlike regex")).groupBy("_u").agg(
        F.max_by(F.struct("name", "verdict"), F.struct(F.col("priority"), -F.col("rid"))).alias("_best")
    )
    joined = df.withColumns({names[0]: F.coalesce(host, F.lit("")), names[1]: F.coalesce(path, F.lit(""))}).join(
        best, F.col(url_col) == best["_u"], "left"
    )
    return joined.withColumns(
        {names[2]: F.col("_best.name"), names[3]: F.coalesce("_best.verdict", F.lit(default))}
    ).drop("_u", "_best")

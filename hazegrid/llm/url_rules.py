"""URL filters (operator 11): rules indexed by their rarest literal token, so that a URL meets only the rules its tokens fetch.

Rules are text of two forms. A site rule, `host/path`, fits its host and all subdomains where the rest of the URL starts with
the path, in this case. A pattern has `*` (anything) or `^` (one character that is neither a-z nor 0-9, or an end) and may fit
anywhere in host and rest, in any case of A-Z. Site rules go before patterns, longer rules before shorter ones, then the smaller
text; what no rule fits is allowed.

A token is a run of a-z and 0-9; a rule's literal tokens are those that must stand whole in every URL it fits. They are counted
over all URLs, and each rule is filed under the one seen least. Rules without such a token are tried on every URL. Up to
`most_rules` rules go to the tasks as one index, and URLs are judged where they are read, without a shuffle; more rules stay a
table that distinct URLs join by token.

A null url, or one without `://`, has an empty host and path and fits site rules never, patterns only if they fit nothing. Long
URLs are read whole; equal ones get equal verdicts; rows may repeat or lack an id. Null rules are left out, a rule given as both
block and allow blocks, other actions are an error, and so are site rules without a slash. Empty tables give empty results. Only the id and url columns
are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, with_path

#: Rules that go to every task at most, some 100 MB; more are joined by token.
MOST_RULES = 200_000
_TOKEN = re.compile("[a-z0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_fold = str.maketrans(_UPPER, _LOWER)


def parse(rule: str) -> tuple[bool, str, list[str]]:
    """(site rule?, regular expression, literal tokens) of a rule; the expression means the same to Python and Java."""
    site = not set("*^") & set(rule)
    if site:
        host, slash, path = rule.partition("/")
        if not slash:
            raise ValueError(f"a site rule needs a slash: {rule!r}")
        rule = host.translate(_fold) + slash + path
    runs = ["".join("(?:[^a-zA-Z0-9]|\\A|\\z)" if c == "^" else "\\" + c if c.isascii() and not c.isalnum() else c for c in run) for run in rule.split("*")]
    text = rule.translate(_fold)
    whole = [m.group() for m in _TOKEN.finditer(text) if (m.start() > 0 or site) and text[m.start() - 1 : m.start()] != "*" and text[m.end() : m.end() + 1] not in ("", "*")]
    # a pattern takes the first place of each of its runs after the one before, without going back, so that its time is linear in the URL
    return site, "\\A(?:[^/]*\\.)?" + runs[0] if site else "(?i)\\A" + "".join(f"(?>[\\s\\S]*?{run})" for run in runs if run), sorted(set(whole))


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, host and all that follows) of a URL."""
    at = F.instr(url, "://")
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.concat(host, F.regexp_extract(after, r"^[^/?#]*([\s\S]*)", 1))


def tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(target, _UPPER, _LOWER), F.lit("[a-z0-9]+"), 0))


def parsed(rules: DataFrame) -> DataFrame:
    """(rule, action, site, regex, tokens) of a rule table (rule, action)."""
    known = rules.select(F.col("rule").cast("string").alias("rule"), F.col("action").cast("string").alias("action")).where(F.col("rule").isNotNull())
    # a rule given twice keeps its block
    known = known.groupBy("rule").agg(F.max("action").alias("action"), F.min(F.col("action").isin("block", "allow")).alias("fine"))
    known = known.withColumn("action", F.when(F.coalesce("fine", F.lit(False)), F.col("action")).otherwise(F.raise_error(F.concat(F.lit("neither block nor allow: "), F.col("rule"))))).drop("fine")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            site, regex, toks = zip(*map(parse, b["rule"])) if len(b) else ((), (), ())
            yield b.assign(site=list(site), regex=list(regex), tokens=list(toks))

    return with_path(known).mapInPandas(run, "rule string, action string, site boolean, regex string, tokens array<string>")


def filed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Parsed rules, each with its `key`: the literal token that the fewest of urls (target) have, or null. Counts cover all URLs."""
    mine = rules.select("rule", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode(tokens(F.col("target"))).alias("token")).join(mine.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    least = mine.join(seen, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).token.alias("key"))
    return rules.join(least, "rule", "left")


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", most_rules: int = MOST_RULES) -> DataFrame:
    """One row a page: id_col, host, path, rule (the one that decides, or null), site (is it a site rule), verdict."""
    host, path, target = parts(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), target.alias("target"))
    known = parsed(rules)
    index = filed(urls, known)
    return _by_index(urls, index, id_col) if rules.count() <= most_rules else _by_join(urls, index)


def _by_index(urls: DataFrame, index: DataFrame, id_col: str) -> DataFrame:
    """Each URL judged in place; the index is bounded by most_rules."""
    kept: dict[str | None, list[tuple]] = {}
    for r in index.collect():
        kept.setdefault(r.key, []).append((not r.site, -len(r.rule), r.rule, r.action, r.regex))
    given = urls.sparkSession.sparkContext.broadcast(kept)
    fold, token, compiled = _fold, _TOKEN, {}

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        kept, out = given.value, []
        for url in b.column("target").to_pylist():
            best = None
            for t in (None, *set(token.findall(url.translate(fold)))):
                for r in kept.get(t, ()):
                    if best is None or r[:3] < best[:3]:
                        fits = compiled.get(r[4]) or compiled.setdefault(r[4], re.compile(r[4].replace("\\z", "\\Z"), re.ASCII))
                        if fits.search(url):
                            best = r
            out.append(best)
        cols = [pa.array([r and r[2] for r in out], pa.string()), pa.array([None if r is None else not r[0] for r in out], pa.bool_()), pa.array(["allow" if r is None else r[3] for r in out], pa.string())]
        return pa.RecordBatch.from_arrays([*b.columns[:3], *cols], [*b.schema.names[:3], "rule", "site", "verdict"])

    kind = urls.schema[0].dataType.simpleString()
    return map_rows(urls, batch, f"`{id_col}` {kind}, host string, path string, rule string, site boolean, verdict string")


def _by_join(urls: DataFrame, index: DataFrame) -> DataFrame:
    """The same for rule tables of any size: distinct URLs join the rules by token, and each URL keeps its best."""
    rules = index.select("rule", "action", "site", "regex", F.coalesce("key", F.lit("")).alias("token"))
    met = urls.select("target").distinct().select("target", F.explode(F.concat(tokens(F.col("target")), F.array(F.lit("")))).alias("token")).join(rules, "token").where(F.expr("rlike(target, regex)"))
    best = met.groupBy("target").agg(F.min(F.struct((~F.col("site")).alias("late"), (-F.length("rule")).alias("size"), "rule", "action")).alias("r"))
    out = urls.join(best, "target", "left")
    return out.select(urls.columns[0], "host", "path", F.col("r.rule").alias("rule"), (~F.col("r.late")).alias("site"), F.coalesce("r.action", F.lit("allow")).alias("verdict"))


def oracle(rules: list[tuple[str, str]]) -> str:
    """The query's rows over the table pages, for DuckDB: every rule's expression on every URL."""
    q = lambda s: s.replace("'", "''")
    made = [(rule, action, parse(rule)[0], parse(rule)[1].replace("(?>", "(?:")) for rule, action in rules]
    order = sorted(made, key=lambda r: (not r[2], -len(r[0]), r[0]))
    case = lambda what, those: "CASE " + " ".join(f"WHEN regexp_matches(target, '{q(regex)}') THEN {what(rule, action)}" for rule, action, _, regex in those)
    text = lambda s: f"'{q(s)}'"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages),
h AS (SELECT page_id, translate(regexp_extract(after, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(after, '(?s)^[^/?#]*(.*)', 1) AS rest FROM a),
t AS (SELECT page_id, host, path, host || rest AS target FROM h)
SELECT page_id, host, path, {case(lambda r, a: text(r), [x for x in order if x[2]])} END AS rule, {case(lambda r, a: text(a), order)} ELSE 'allow' END AS verdict,
  CASE WHEN {" OR ".join(f"regexp_matches(target, '{q(x[3])}')" for x in order if x[2])} THEN NULL ELSE {case(lambda r, a: text(r), [x for x in order if not x[2]])} END END AS pattern
FROM t"""

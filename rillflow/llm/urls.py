"""URL filter by rules and by a tree of path templates, in DataFrame functions only.

Rules give a verdict first. For the rest, each host has a tree of path templates: a segment that looks variable (numbers,
dates, hashes), or that is one of many under the same parent, becomes a wildcard; parents are generalised first, level by
level. A page that a rule, a word or a given label calls bad counts as bad, a page that one of them calls good as good,
and a page without any label as good with a part of that weight. A template's share of bad pages is that of its siblings
which do not differ from it by a test of proportions, smoothed towards its parent template's, and so on up to the host's
and the whole table's; so a template without a label of its own has a share too. It is rejected where the share is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read

#: (verdict, host, start of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of hosts and paths that label a page as bad, where no letter is next to them.
BAD_WORDS = ("casino", "bets", "betting", "poker", "pills", "viagra", "porn", "xxx", "adserver", "doubleclick", "ads-track", "malware", "phishing")
#: Most levels of a template, those below being one; a node with so many children, which are so large a share of its pages, has a wildcard.
DEPTH, CHILDREN, SPREAD = 12, 8, 0.5
#: Parts of the rows of a host or template in a join with what is known of it.
SALTS = 16
#: Weight of a page without a label, as evidence that its template is not bad.
UNLABELLED = 0.25
#: Weight of the level above in smoothing, the smoothed share that rejects, and z below which siblings are alike.
PRIOR, REJECT, ALIKE = 1.0, 0.7, 1.96
VARIABLE = r"^(\d+|\d+[-_.]\w+|[0-9a-f]{8,}|[0-9a-f]{8}-[0-9a-f-]{27}|[\w-]*\d{3,}[\w-]*)(\.[a-z]{2,5})?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _segments(path: Column) -> Column:
    """Segments of a path, variable ones as *, deeper ones than the tree has as one **."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    return F.when(F.size(parts) <= DEPTH, parts).otherwise(F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("**"))))


def _salted(many: DataFrame, few: DataFrame, on: list[str], by: str) -> DataFrame:
    """many left-joined with few on the columns `on`; rows of a hot key meet copies of its row, a share of them each."""
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [*on, "_salt"], "left").drop("_salt")


def _templates(paths: DataFrame, levels: int) -> DataFrame:
    """paths (host, _s and counts, with pages) and their template _t: /-led segments, those of wide nodes as *."""
    t = paths.withColumn("_t", F.lit(""))
    for d in range(levels):
        seg = F.get("_s", F.lit(d))
        nodes = t.where(F.size("_s") > d).withColumn("_seg", seg).where("_seg not in ('*', '**')").groupBy("host", "_t", "_seg").agg(F.sum("pages").alias("n"))
        wide = nodes.groupBy("host", "_t").agg(F.count("*").alias("children"), F.sum("n").alias("n")).where((F.col("children") >= CHILDREN) & (F.col("children") >= F.col("n") * SPREAD))
        t = _salted(t, wide.select("host", "_t", F.lit(True).alias("_wide")), ["host", "_t"], "_s")
        t = t.withColumn("_t", F.when(F.size("_s") > d, F.concat("_t", F.lit("/"), F.when(F.col("_wide") & (seg != "**"), "*").otherwise(seg))).otherwise(F.col("_t"))).drop("_wide")
        t = materialize(t, f"templates-{d}")
    return t.withColumn("_t", F.when(F.size("_s") > DEPTH, F.concat("_t", F.lit("/**"))).otherwise(F.col("_t")))


def _shares(t: DataFrame, levels: int) -> DataFrame:
    """Of every template of t (host, _t, n, b): share, its smoothed share of bad pages."""
    depth = F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("/"), F.lit("")))
    tree = t.groupBy("host", "_t").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).withColumn("_d", depth).withColumn("_up", F.regexp_replace("_t", r"/[^/]*$", ""))
    tree = materialize(tree, "template-counts")
    whole = tree.agg(F.sum("n").alias("_wn"), F.sum("b").alias("_wb"))
    smoothed = lambda b, n, above: (F.col(b) + PRIOR * above) / (F.col(n) + PRIOR)
    # The share of each node above, from the table down; a node with all pages of the one above it says nothing new.
    out = _salted(tree.crossJoin(F.broadcast(whole)), tree.groupBy("host").agg(F.sum("n").alias("_hn"), F.sum("b").alias("_hb")), ["host"], "_t")
    out = out.withColumn("_p", smoothed("_hb", "_hn", F.col("_wb") / F.col("_wn"))).withColumn("_last", F.col("_hn")).drop("_wn", "_wb", "_hn", "_hb")
    for d in range(1, levels + 1):
        node = F.substring_index("_t", "/", d + 1)
        level = tree.where(F.col("_d") >= d).groupBy("host", node.alias("_node")).agg(F.sum("n").alias("_nn"), F.sum("b").alias("_nb"))
        out = _salted(out.withColumn("_node", F.when(F.col("_d") > d, node)), level, ["host", "_node"], "_t")
        out = out.withColumn("_p", F.when(F.col("_nn") < F.col("_last"), smoothed("_nb", "_nn", F.col("_p"))).otherwise(F.col("_p")))
        out = out.withColumn("_last", F.coalesce("_nn", "_last")).drop("_node", "_nn", "_nb")
    # Siblings that do not differ from all under their parent are one.
    siblings = tree.groupBy("host", "_up").agg(F.sum("n").alias("_pn"), F.sum("b").alias("_pb"))
    rate = F.col("_pb") / F.col("_pn")
    z = (F.col("b") / F.col("n") - rate) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-6)) / F.col("n"))
    out = materialize(_salted(out, siblings, ["host", "_up"], "_t").withColumn("_alike", F.abs(z) < ALIKE), "template-siblings")
    merged = out.where("_alike").groupBy("host", "_up").agg(F.sum("n").alias("_mn"), F.sum("b").alias("_mb"))
    out = _salted(out, merged, ["host", "_up"], "_t")
    own = lambda m, x: F.when(F.col("_alike"), F.col(m)).otherwise(F.col(x))
    out = out.withColumn("_on", own("_mn", "n")).withColumn("_ob", own("_mb", "b"))
    return out.select("host", "_t", F.when(F.col("n") < F.col("_last"), smoothed("_ob", "_on", F.col("_p"))).otherwise(F.col("_p")).alias("share"))


def template_filter(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """All columns of pages (it needs url) and host, path, rule, verdict; columns of these names are replaced.

    labels: url and bad (0 or 1), one row each, beside the labels that rules and BAD_WORDS give. A page without a host is
    allowed; repeated rows have equal verdicts, and an empty table gives no rows. Pages are counted by their path's segments before anything is joined, and the joins are salted, so that a hot
    host or template is dealt among tasks.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col("url").cast("string"))
    df = pages.select(*keep).withColumn("host", host).withColumn("path", path).withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    df = df.withColumn("_s", F.when(F.col("host") != "", _segments(F.col("path"))).otherwise(F.array().cast("array<string>")))

    bad_word = F.concat_ws("", "host", F.lower("path")).rlike(f"(?<![a-z])({'|'.join(BAD_WORDS)})(?![a-z])")
    bad = F.when(F.col("_r.verdict") == "block", 1).when(F.col("_r.verdict") == "allow", 0).when(bad_word, 1)
    known = df.where("host != ''").select("host", "_s", "url", bad.alias("bad"))
    if labels is not None:
        known = known.join(labels.select("url", F.col("bad").cast("int").alias("given")).dropDuplicates(["url"]), "url", "left").withColumn("bad", F.coalesce("given", "bad"))
    weight = F.when(F.col("bad").isNull(), UNLABELLED).otherwise(1.0)
    paths = known.groupBy("host", "_s").agg(F.count("*").alias("pages"), F.sum(weight).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("b"))
    paths = materialize(paths, "paths")
    levels = min(DEPTH, paths.agg(F.max(F.size("_s"))).first()[0] or 0)
    t = _templates(paths, levels)
    rejected = _shares(t, levels).where(F.col("share") >= REJECT).select("host", "_t", F.lit(True).alias("_no"))
    no = _salted(t.select("host", "_s", "_t"), rejected, ["host", "_t"], "_s").where("_no").select("host", "_s", "_no")
    df = _salted(df, no, ["host", "_s"], "url")
    verdict = F.coalesce("_r.verdict", F.when(F.col("_no"), "block").otherwise("allow"))
    return df.select(*keep, "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return template_filter(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")

"""Resolution joins: calls to APIs, URLs to services, files to services, paths to owners.

Candidate sets (services, APIs, rules) are equi-joined wherever the rule allows; pattern joins
take only rule tables of a checked size, otherwise they fail rather than broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import is_hole, owner_rule_regex, segments, url_host, url_path

RULES_MAX = 50_000


#: Endings of hosts and service names that say nothing about the service, stripped in this order.
HOST_SUFFIXES = ("-service", "-api", "-svc", ".local", ".cluster.local", ".internal")
_HOLE = "{var}"


def bare_host(c: Column) -> Column:
    """A host or service name without the common endings, up to its first dot."""
    out = F.lower(c)
    for suffix in HOST_SUFFIXES:
        out = F.regexp_replace(out, suffix.replace(".", r"\.") + r"\z", "")
    return F.substring_index(out, ".", 1)


def resolve_apis(calls: DataFrame, apis: DataFrame, service_hosts: dict[str, list[str]] | None = None, strict: bool = False) -> DataFrame:
    """calls(call_id, method, url[, is_template]) to apis(api_id, method, template, hosts[, service]): call_id, api_id, confidence, reason.

    Paths match if they have as many segments and all literal ones agree. Among the matches, an
    API whose hosts (or whose service's in `service_hosts`) name the URL's host comes first: HIGH
    if the path match is unique, else MEDIUM. Next comes one whose service name and the host
    contain one another without their common endings: MEDIUM. Template URLs and those without a
    host take the match of most literal segments: MEDIUM; others take it as LOW, or with `strict`
    stay unresolved for that reason. Ties go to the smaller api_id. Without a match the reason is no-match.

    The join goes by method, number of segments, and place and text of one literal segment of the
    template (its longest); a hole in the call meets all. Templates without literals join apart.
    """
    url = F.regexp_replace("url", r"\$?\{[^}]*\}", _HOLE)
    rest = F.when(F.startswith(url, F.lit(_HOLE)), F.regexp_replace(F.substr(url, F.lit(len(_HOLE) + 1)), "^/?", "/")).otherwise(url)
    known = rest.rlike("^(?:/|[A-Za-z][A-Za-z0-9+.-]*://)")
    template = F.coalesce(F.col("is_template"), F.lit(False)) if "is_template" in calls.columns else F.lit(False)
    c = calls.where(known).select("call_id", F.upper("method").alias("m"), url_host(rest).alias("host"), template.alias("free"), segments(url_path(rest)).alias("segs"))
    service = F.col("service") if "service" in apis.columns else F.lit(None).cast("string")
    a = apis.select("api_id", F.upper("method").alias("m"), segments(F.col("template")).alias("t"), F.transform("hosts", F.lower).alias("hosts"), F.lower(service).alias("service"))
    a = a.withColumn("literal", F.size(F.filter("t", lambda s: ~is_hole(s))))
    places = F.filter(F.transform("t", lambda s, i: F.struct(F.when(is_hole(s), -1).otherwise(F.length(s)).alias("len"), i.alias("pos"), s.alias("text"))), lambda x: x["len"] >= 0)
    best = F.array_max(places)
    a = a.select("*", F.size("t").alias("n"), F.coalesce(best["pos"], F.lit(-1)).alias("pos"), F.explode(F.when(best.isNull(), F.array(F.lit(""))).otherwise(F.array_distinct(F.array(best["text"], F.lit(_HOLE))))).alias("text"))
    seen = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("text"))), F.transform("segs", lambda s, i: F.struct(i.alias("pos"), s.alias("text"))))
    c = c.select("*", F.size("segs").alias("n"), F.explode(seen).alias("x")).select("*", "x.pos", "x.text")
    agree = F.forall(F.zip_with("t", "segs", lambda t, s: is_hole(t) | (s == _HOLE) | (t == s)), lambda x: x)
    both = c.join(a, ["m", "n", "pos", "text"]).where(agree)
    listed = F.lit(False)
    for name, hosts in (service_hosts or {}).items():
        listed = listed | ((F.col("service") == name.lower()) & F.col("host").isin(*(h.lower() for h in hosts)))
    near = (bare_host(F.col("host")), bare_host(F.col("service")))
    has_host = F.col("host") != ""
    rank = (
        F.when(has_host & F.array_contains("hosts", F.col("host")), 0).when(has_host & F.coalesce(listed, F.lit(False)), 1)
        .when(has_host & F.coalesce(F.contains(near[0], near[1]) | F.contains(near[1], near[0]), F.lit(False)), 2).otherwise(3)
    )
    order = F.struct(rank.alias("rank"), F.when(rank == 3, -F.col("literal")).otherwise(0).alias("vague"), "api_id")
    chosen = both.groupBy("call_id").agg(F.min(order).alias("x"), F.count(F.lit(1)).alias("matches"), F.first(F.col("free") | ~has_host).alias("free"))
    kind = F.when(F.col("x.rank") < 2, "exact-host+path").when(F.col("x.rank") == 2, "fuzzy-host+path")
    kind = kind.when(F.col("free"), F.when(F.col("matches") == 1, "template-path-unique").otherwise("template-path-multi")).otherwise("path-only-no-host-match")
    sure = F.when((F.col("x.rank") < 2) & (F.col("matches") == 1), "HIGH").when((F.col("x.rank") < 3) | F.col("free"), "MEDIUM").otherwise("LOW")
    rows = calls.select("call_id").join(chosen.select("call_id", "x.api_id", sure.alias("confidence"), kind.alias("reason")), "call_id", "left")
    dropped = (F.col("confidence") == "LOW") & F.lit(strict)
    kept = lambda name: F.when(~F.coalesce(dropped, F.lit(False)), F.col(name)).alias(name)
    return rows.select("call_id", kept("api_id"), kept("confidence"), F.coalesce("reason", F.lit("no-match")).alias("reason"))


def resolve_services(urls: DataFrame, services: DataFrame) -> DataFrame:
    """urls(url_id, url) to services(service_id, name): url_id, service_id, confidence.

    HIGH: the host is the name, or with a cluster's DNS ending, or starts with the name and a dot or
    hyphen. Else HIGH: an environment placeholder `${...}` shares two of the name's tokens (its one
    token). Else MEDIUM: the URL contains the name, hyphens and underscores alike. Of several the
    smallest service_id. All three are equi-joins: on prefixes of the host, on pairs of tokens (so
    that no common token alone meets anything), and on the name's first letters.
    """
    plain = F.regexp_replace("url", r"\$\{[^}]*\}", _HOLE)
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z]+://([^/:?#]+)", 1))
    u = urls.where("url <> ''").select("url_id", F.lower(plain).alias("low"), host.alias("host"), F.regexp_extract_all("url", F.lit(r"\$\{([A-Z_][A-Z0-9_]*)\}"), F.lit(1)).alias("env"))
    s = services.where("name <> ''").select("service_id", F.lower("name").alias("name"))
    cuts = F.filter(F.sequence(F.lit(1), F.length("host")), lambda i: F.substring(F.col("host"), i, F.lit(1)).isin(".", "-"))
    stems = F.concat(F.array("host", F.regexp_replace("host", r"\.[\w-]+\.svc(?:\.cluster\.local)?$", "")), F.transform(cuts, lambda i: F.substring(F.col("host"), F.lit(1), i - 1)))
    named = u.where("host <> ''").select("url_id", F.explode(F.array_distinct(stems)).alias("name")).join(s, "name").select("url_id", "service_id", F.lit(0).alias("rank"))

    def token_keys(tokens: Column) -> Column:
        """Single tokens, and pairs of tokens in order, of an array of distinct ones."""
        pairs = F.flatten(F.transform(tokens, lambda a: F.transform(F.filter(tokens, lambda b: a < b), lambda b: F.concat_ws("|", a, b))))
        return F.concat(tokens, pairs)

    long = lambda c: F.array_distinct(F.filter(c, lambda t: F.length(t) > 2))
    env = F.filter(F.flatten(F.transform("env", lambda e: F.split(F.lower(e), "_"))), lambda t: ~t.isin("url", "host", "endpoint"))
    parts = F.split("name", "[-_]")
    # a name of one token meets by it, any other by pairs only
    needed = F.filter(token_keys(long(parts)), lambda k: (F.size(parts) == 1) | F.contains(k, F.lit("|")))
    asked = u.where(F.size("env") > 0).select("url_id", F.explode(token_keys(long(env))).alias("key"))
    hinted = asked.join(s.select("service_id", F.explode(needed).alias("key")), "key").select("url_id", "service_id", F.lit(1).alias("rank"))

    first = F.least(F.length("variant"), F.lit(8))
    variants = s.select("service_id", F.explode(F.array_distinct(F.array("name", F.replace("name", F.lit("-"), F.lit("_")), F.replace("name", F.lit("_"), F.lit("-"))))).alias("variant"))
    variants = variants.where(F.length("variant") > 2).withColumn("key", F.substring("variant", F.lit(1), first))
    better = named.unionByName(hinted)
    left = u.join(better.select("url_id").distinct(), "url_id", "left_anti").where(F.length("low") > 2)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.length("low")), lambda i: F.transform(F.sequence(F.lit(3), F.lit(8)), lambda n: F.substring(F.col("low"), i, n))))
    within = left.select("url_id", "low", F.explode(F.array_distinct(runs)).alias("key")).join(variants, "key").where(F.contains("low", F.col("variant"))).select("url_id", "service_id", F.lit(2).alias("rank"))
    best = better.unionByName(within).groupBy("url_id").agg(F.min(F.struct("rank", "service_id")).alias("x"))
    return urls.select("url_id").join(best.select("url_id", "x.service_id", F.when(F.col("x.rank") < 2, "HIGH").otherwise("MEDIUM").alias("confidence")), "url_id", "left")


def service_of_files(files: DataFrame, services: DataFrame) -> DataFrame:
    """files(path) to services(service, directory) by the longest directory prefix; else the service of the shortest directory.

    Each path is joined on all its ancestor directories, so the join is an equi-join.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.select("path", F.explode(ancestors).alias("directory")).join(services, "directory").groupBy("path").agg(F.max_by("service", F.length("directory")).alias("service"))
    fallback = services.agg(F.min_by("service", F.struct(F.length("directory"), "service")).alias("fallback"))
    return files.select("path").join(rows, "path", "left").crossJoin(fallback).select("path", F.coalesce("service", "fallback").alias("service"))  # one row


def owners_of_files(files: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """files(path) to the owners of the last rule (pattern, owners) that matches: path, owner, one row each."""
    if len(rules) > RULES_MAX:
        raise ValueError(f"more than {RULES_MAX} rules")
    spark = files.sparkSession
    table = spark.createDataFrame([(i, owner_rule_regex(p), o) for i, (p, o) in enumerate(rules)], "seq int, re string, owners array<string>")
    hit = files.select("path").join(F.broadcast(table), F.expr("path rlike re"))  # RULES_MAX rows at most
    return hit.groupBy("path").agg(F.max_by("owners", "seq").alias("owners")).select("path", F.explode("owners").alias("owner"))

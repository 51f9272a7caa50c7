"""URL filters: rule lists, then host reputation by empirical Bayes.

Labelled page outcomes are counted by host. A host's rate of bad pages is shrunk towards its
registered domain's, that towards its suffix's, that towards the rate of all; each step is a
beta-binomial prior whose strength is fitted by moments to the spread of the level below, and is weak
where that spread is little known. A page is blocked if the lower bound of its host's posterior lies above a limit.

Where pages have no labels of their own, ``outcome_model`` fits two classes of text on labelled documents and
``with_outcome`` labels a page by its visible text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import WORD, ascii_lower, cut, free_name, lookup


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Public suffixes of two labels under which names are registered (from the public suffix list). A
#: parameter of the functions below; suffixes of one label need no list.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "police.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "co.nz", "govt.nz", "net.nz", "org.nz",
    "ac.jp", "ad.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "co.kr", "go.kr", "or.kr", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.tw", "org.tw", "com.hk", "com.sg", "com.my", "co.id", "co.th", "co.in", "net.in", "org.in",
    "com.br", "gov.br", "net.br", "org.br", "com.ar", "com.mx", "com.co", "com.pe", "co.za", "org.za", "com.tr", "gov.tr", "org.tr", "co.il", "org.il", "com.ua", "com.pl", "org.pl", "com.gr", "com.pt", "com.ru",
)


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix: the last two labels if they are one of ``suffixes``, else the last label."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1)) if suffixes else F.substring_index(host, ".", -1)


def registered_domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix and one label more; a host that is a suffix is its own domain."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two) if suffixes else two


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` (action, host, path) that fits, as text, and its action; nulls if none fits.

    A rule fits its host and all hosts below it, if the path starts with the rule's. The list is part
    of the program, so it becomes one expression, tried from the longest rule on.
    """
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:], r[0])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def visible_text(html: Column) -> Column:
    """HTML without scripts, styles and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")


FEATURES = ("letters", "symbols", "capitals", "digits", "different", "word_chars")


def _with_features(df: DataFrame, text: Column) -> tuple[DataFrame, list[str], str]:
    """``df`` with the features of ``text``, their names and the name of another column that was added.

    Shares of letters, symbols, capitals and digits among the characters, of different words among the words, and the characters of a
    word to 10 as a share of 1; null for a text without words. Text and words are columns of their own, so that each is computed once a row.
    """
    at, words_at, names = free_name(df, "feature_text"), free_name(df, "feature_words"), [free_name(df, f) for f in FEATURES]
    held = df.withColumn(at, text).withColumn(words_at, F.regexp_extract_all(F.col(at), F.lit(f"({WORD})"), F.lit(1)))
    n = F.length(at)
    share = lambda pattern: F.try_divide(n - F.length(F.regexp_replace(at, pattern, "")), n).cast("double")
    per_word = F.least(F.try_divide(F.length(F.regexp_replace(at, r"[\x20\x09-\x0D]+", "")), 10 * F.size(words_at)).cast("double"), F.lit(1.0))
    values = [share(r"\p{L}+"), share(r"[^\p{L}\p{N}\x20\x09-\x0D]+"), share(r"\p{Lu}+"), share(r"\p{N}+"), F.try_divide(F.size(F.array_distinct(words_at)), F.size(words_at)).cast("double"), per_word]
    held = held.withColumns({name: F.when(F.size(words_at) > 0, v) for name, v in zip(names, values)})
    return held.drop(words_at), names, at


#: Added to the variances of features, which are shares: a class of equal texts isn't taken for certain.
VARIANCE_FLOOR = 0.0025


def outcome_model(docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[float, list[float], list[float]]] | None:
    """Two classes of text, good and bad (1), each as its log share and the features' means and variances; None if a
    class has no row.

    ``labels`` is (id, bad). The model is fitted on at most ``rows`` labels, those of the smallest MD5 of the id, which
    are broadcast, so features are computed for these documents only and no text is shuffled. Null labels and texts
    without words are left out.
    """
    # Over-wide candidates go before the sort, by a threshold that the count sets, so one task sorts about as many as are taken.
    total, draw = labels.count(), F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long")
    near = labels if total <= 2 * rows else labels.filter(F.col(id_col).isNull() | (draw < F.lit(int(2**32 * min(1.0, (rows + 10 * rows**0.5 + 100) / total)))))
    sample = near.orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(rows).select(F.col(id_col).alias("id"), F.col("bad").cast("int").alias("bad"))
    held, names, _ = _with_features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id"), F.col("text"))
    known = held.filter(f"bad in (0, 1) and {names[0]} is not null")
    sums = {r["bad"]: r for r in known.groupBy("bad").agg(F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"m_{n}") for n in names], *[F.var_pop(n).alias(f"v_{n}") for n in names]).collect()}
    if len(sums) < 2:
        return None
    total = sum(r["n"] for r in sums.values())
    return [(math.log(sums[k]["n"] / total), [sums[k][f"m_{n}"] for n in names], [sums[k][f"v_{n}"] + VARIANCE_FLOOR for n in names]) for k in (0, 1)]


def with_outcome(pages: DataFrame, text: Column, model: list | None, name: str) -> DataFrame:
    """``pages`` with ``name``: 1 if the bad class is the likelier one of a text (independent normal features), else 0; null
    without words or model. A column of this name is replaced; repeated rows get equal values."""
    if model is None:
        return pages.withColumn(name, F.lit(None).cast("int"))
    held, names, at = _with_features(pages, text)
    good, bad = (sum((-0.5 * math.log(v) - (F.col(x) - m) * (F.col(x) - m) / (2 * v) for x, m, v in zip(names, means, variances)), F.lit(prior)) for prior, means, variances in model)
    return held.withColumn(name, (bad > good).cast("int")).drop(at, *names)


#: A prior's strength in pages where its children tell nothing of their spread, and how many children that counts as.
WEAK_PAGES, WEAK_CHILDREN = 8.0, 4.0


def _level(below: DataFrame, key: str, up: str | None) -> DataFrame:
    """Sums of ``below`` (key columns, n, bad) by ``up``, with the strength m of the prior that it gives the level below.

    Moments: the mean of squared deviations of the children's rates, weighted by n, less what binomial noise
    explains, over mean * (1 - mean), is phi = 1 / (m + 1). It is averaged with the weak prior's: a child of n pages counts as
    1 - 1 / n, for one page tells nothing of the spread between children.
    """
    n, bad = F.col("n"), F.col("bad")
    has = n > 0
    s = below.groupBy(*([up] if up else [])).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.when(has, 1)).alias("k"), F.sum(F.when(has, bad * F.try_divide(bad, n))).alias("q"),
        F.sum(n * n).alias("nn"), F.sum(F.when(has, 1 - F.try_divide(F.lit(1.0), n))).alias("informed"),
    )
    mean = F.coalesce(F.try_divide(F.col("bad"), F.col("n")), F.lit(0.0))
    spread = mean * (1 - mean)
    var = F.try_divide(F.coalesce("q", F.lit(0.0)) - F.col("n") * mean * mean - (F.col("k") - 1) * spread, F.col("n") - F.try_divide(F.col("nn"), F.col("n")))
    phi = F.least(F.greatest(F.coalesce(F.try_divide(var, spread), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    known = F.when((spread > 0) & var.isNotNull(), F.greatest(F.coalesce("informed", F.lit(0.0)) - 1, F.lit(0.0))).otherwise(0.0)
    m = F.try_divide(known + WEAK_CHILDREN, known * phi + WEAK_CHILDREN / (WEAK_PAGES + 1)) - 1
    return s.select(*([up] if up else []), F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("bad", F.lit(0.0)).alias("bad"), F.greatest(m, F.lit(1.0)).alias("m"))


def _shrunk(level: str) -> tuple[Column, Column]:
    """The posterior mean and variance of n, bad under the prior rate, var and m of ``level``. The share of the prior in the mean
    carries its variance on."""
    n, bad, m = F.col("n"), F.col("bad"), F.col(f"{level}_m")
    rate = (bad + m * F.col(f"{level}_rate")) / (n + m)
    return rate, rate * (1 - rate) / (n + m + 1) + F.pow(m / (n + m), 2.0) * F.col(f"{level}_var")


def beta_quantile(mean: Column, var: Column, z: float) -> Column:
    """The quantile of a beta distribution of this mean and variance, z normal deviations below its middle (Abramowitz and Stegun 26.5.22).

    0 if it has the evidence of less than one bad page, z deviations below the mean if of less than one good page, and the mean without a variance.
    """
    size = F.try_divide(mean * (1 - mean), var) - 1
    a, b = mean * size, (1 - mean) * size
    p, q = F.try_divide(F.lit(1.0), 2 * a - 1), F.try_divide(F.lit(1.0), 2 * b - 1)
    h, skew = F.try_divide(F.lit(2.0), p + q), (z * z - 3) / 6
    w = z * F.try_divide(F.sqrt(h + skew), h) - (q - p) * (skew + 5 / 6 - F.try_divide(F.lit(2.0), 3 * h))
    inside = F.try_divide(a, a + b * F.exp(2 * w))
    return F.when(size.isNull(), mean).when(a < 1, 0.0).when(b < 1, mean - z * F.sqrt(var)).otherwise(inside)


def host_reputation(outcomes: DataFrame, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Of ``outcomes`` (host, bad: 1, 0, or null if not labelled): one row for each host with n, bad, rate, lower.

    ``rate`` is the posterior mean and ``lower`` the quantile z normal deviations below the middle (5 % for 1.645) of the beta distribution with the posterior's
    mean and variance, the uncertainty of the levels above included. A host without labelled pages has its domain's rate, a domain
    without any its suffix's, and so on; with no label at all every rate is 0. Every step is a grouped aggregation, the
    first with a partial one before the shuffle; the joins are between aggregates.
    """
    domain, suffix = registered_domain_of(F.col("host"), suffixes), suffix_of(F.col("host"), suffixes)
    hosts = cut(
        outcomes.groupBy("host")
        .agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
        .withColumns({"domain": domain, "suffix": suffix})
    )
    domains = _level(hosts, "host", "domain").withColumn("suffix", suffix_of(F.col("domain"), suffixes))
    all_suffixes = _level(domains, "domain", "suffix")
    top = _level(all_suffixes, "suffix", None).first()
    top_rate = top["bad"] / top["n"] if top["n"] else 0.0
    given = {"top_rate": top_rate, "top_var": top_rate * (1 - top_rate) / (top["n"] + 1), "top_m": top["m"]}

    def shrunk(rows: DataFrame, key: str, level: str, name: str) -> DataFrame:
        rate, var = _shrunk(level)
        return rows.select(key, F.col("m").alias(f"{name}_m"), rate.alias(f"{name}_rate"), var.alias(f"{name}_var"))

    suf = shrunk(all_suffixes.withColumns({c: F.lit(float(v)) for c, v in given.items()}), "suffix", "top", "suffix")
    dom = shrunk(domains.join(suf, "suffix"), "domain", "suffix", "domain")
    rate, var = _shrunk("domain")
    return hosts.join(dom, "domain").select("host", "n", "bad", rate.alias("rate"), beta_quantile(rate, var, z).alias("lower"))


def filter_urls(pages: DataFrame, bad: Column, rules: Sequence[tuple[str, str, str]], limit: float, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every page with host, path, rule, verdict, the host's posterior rate and its lower bound.

    ``bad`` labels a page (1 bad, 0 good, null unlabelled). A fitting rule decides; else a page is blocked
    if its host's lower bound is over ``limit``. A null url, or one without ``://``, has an empty host
    and path and is judged as the host "". Repeated rows are judged each; an empty table gives none.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    reputation = cut(host_reputation(pages.select(host_of(url).alias("host"), bad.cast("int").alias("bad"))).select("host", "rate", "lower"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return lookup(rows, reputation, ["host"]).select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(action, judged).alias("verdict"), F.round("rate", 6).alias("rate"), F.round("lower", 6).alias("lower")
    )

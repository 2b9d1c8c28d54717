"""URL filters: rules on host and path, then a list of URLs behind a Bloom filter.

Everything is a DataFrame function.  A listed URL and a page's URL are brought
to one canonical form.  The list becomes a *blocked* Bloom filter: a URL's hash
chooses one block of eight 64-bit words and sets one bit in each, so a probe
touches one row only.  Pages whose block lacks a bit are surely not listed and
never leave their task; the rest go through an exact hash join with the list,
which removes the false positives.

The filter has at most ``MAX_BLOCKS`` rows of 72 bytes whatever the length of
the list, so it may be broadcast.  A list too long for that many blocks only
makes the filter let more through; the exact join still decides.  Copies of one
URL in the list are taken together before it is joined; a URL that very many
pages share skews only the side of the join that Spark can split.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and no list and is allowed; an empty list blocks nothing; repeated rows
are judged apart; other columns of the input are left out, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from joeira.llm.common import ascii_lower

WORDS = 8  # 64-bit words in a block, one bit set in each by a URL
MAX_BLOCKS = 1 << 16  # 4.5 MB broadcast at most
URLS_PER_BLOCK = 24  # about 21 bits for a URL: some 1 in 1000 false positives
# Parameters that tell where a click came from, not what is shown.
TRACKING = "utm_[^=&]*|ref|gclid|fbclid"

Rule = tuple[str, str, str]  # verdict, host, path


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and what follows from the path on, without the fragment."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return host, path, query


def canonical(host: Column, path: Column, query: Column) -> Column:
    """One text for all spellings of a URL; null without a host.

    Scheme, ``www.``, default ports, fragment, tracking parameters and a
    slash at the end do not count.
    """
    plain = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^(?:{TRACKING})(?:=|$)"))
    asked = F.array_join(F.sort_array(kept), "&")
    text = F.concat(plain, F.regexp_replace(path, r"/+$", ""), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))
    return F.when(host != "", text)


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null; equal lengths go by the text."""
    text = verdict = None
    for said, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        if said not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {said!r}")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)) if text is None else text.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def _shifted(i: int) -> str:
    return f"shiftleft(1L, CAST(shiftright(_second, {6 * i}) & 63 AS INT))"


def bloom_blocks(urls: DataFrame, url_col: str, n_blocks: int) -> DataFrame:
    """``_block`` and the words ``_w0`` to ``_w7`` of the filter, blocks without a URL left out."""
    keyed = urls.select(
        F.pmod(F.xxhash64(url_col), F.lit(n_blocks)).cast("int").alias("_block"), F.xxhash64(F.col(url_col), F.lit(1)).alias("_second")
    )
    return keyed.groupBy("_block").agg(*[F.expr(f"bit_or({_shifted(i)})").alias(f"_w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, listed`` for every page.

    ``listed`` holds URLs that are blocked unless a rule says otherwise.
    """
    host, path, query = url_parts(F.col("_url"))
    on_list = (
        listed.select(F.col(listed_col).alias("_url")).select(canonical(*url_parts(F.col("_url"))).alias("_listed"))
        .where("_listed IS NOT NULL").distinct()
    )
    n_urls = on_list.count()
    n_blocks = min(MAX_BLOCKS, max(1, -(-n_urls // URLS_PER_BLOCK)))
    blocks = bloom_blocks(on_list, "_listed", n_blocks)

    seen = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", host.alias("host"), path.alias("path"), query.alias("_query"))
    seen = seen.withColumn("_canon", canonical(F.col("host"), F.col("path"), F.col("_query"))).drop("_query")
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "_said": said})
    probed = seen.withColumns({
        "_block": F.pmod(F.xxhash64("_canon"), F.lit(n_blocks)).cast("int"), "_second": F.xxhash64(F.col("_canon"), F.lit(1)),
    }).join(F.broadcast(blocks), "_block", "left")
    all_set = " AND ".join(f"_w{i} & {_shifted(i)} != 0" for i in range(WORDS))
    probed = probed.withColumn("_maybe", F.expr(f"_said IS NULL AND _canon IS NOT NULL AND coalesce({all_set}, false)"))

    def out(df: DataFrame, found: Column) -> DataFrame:
        verdict = F.coalesce("_said", F.when(found, F.lit("block")).otherwise(F.lit("allow")))
        return df.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), found.alias("listed"))

    sure = out(probed.where("NOT _maybe"), F.lit(False))
    checked = probed.where("_maybe").join(on_list.hint("shuffle_hash"), F.col("_canon") == F.col("_listed"), "left")
    return sure.unionByName(out(checked, F.col("_listed").isNotNull()))

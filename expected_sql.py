"""SQL twins of the queries, for DuckDB, over the same tables.

Written on their own from the meaning of each query: where Spark reads a
statistic off a table of counts, for instance, the SQL asks for it directly.
"""

from __future__ import annotations

ENC = """
enc_base AS (
  SELECT o_orderkey k, CAST(o_orderdate AS DATE) d, o_orderpriority p, o_custkey ck, c_name, c_mktsegment seg
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
enc_days AS (SELECT *, d + CAST(k%90-5 AS INT) AS e FROM enc_base),
enc AS (
  SELECT k AS row_idx,
    CASE WHEN k%97=0 THEN NULL WHEN k%89=0 THEN concat('X', CAST((k // 89) % 40 AS VARCHAR))
         ELSE concat(lpad(CAST((year(d)+CASE WHEN k%53=0 THEN 1 ELSE 0 END)%100 AS VARCHAR),2,'0'),
                     lpad(CAST(k%997 AS VARCHAR),3,'0')) END AS ID,
    CASE WHEN k%61=0 THEN NULL WHEN k%59=0 THEN concat('P/',CAST(ck AS VARCHAR)) ELSE CAST(ck AS VARCHAR) END AS processo,
    CASE WHEN k%101=0 THEN '' ELSE c_name END AS nome,
    CASE WHEN k%83=0 THEN '' WHEN k%79=0 THEN concat('31-02-',CAST(year(d) AS VARCHAR))
         WHEN k%73=0 THEN concat(CAST(year(d) AS VARCHAR),'/',CAST(month(d) AS VARCHAR),'/',CAST(day(d) AS VARCHAR))
         ELSE concat(CAST(day(d) AS VARCHAR),'-',CAST(month(d) AS VARCHAR),'-',CAST(year(d) AS VARCHAR)) END AS data_ent,
    CASE WHEN k%11=0 THEN NULL
         ELSE concat(CAST(day(e) AS VARCHAR),'-',CAST(month(e) AS VARCHAR),'-',CAST(year(e) AS VARCHAR)) END AS data_alta,
    p AS destino,
    CASE seg WHEN 'BUILDING' THEN 'M' WHEN 'MACHINERY' THEN 'F' WHEN 'HOUSEHOLD' THEN 'M' WHEN 'FURNITURE' THEN 'f' END AS sexo,
    concat(CAST(1+k%28 AS VARCHAR),'-',CAST(1+k%12 AS VARCHAR),'-',CAST(1890+k%115 AS VARCHAR)) AS data_nasc,
    seg AS origem
  FROM enc_days)"""

_SHAPE = "[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"


def _shaped(c: str) -> str:
    return f"coalesce(regexp_full_match({c}, '{_SHAPE}'), false)"


def _date(c: str) -> str:
    return f"CASE WHEN {_shaped(c)} THEN CAST(try_strptime({c}, '%d-%m-%Y') AS DATE) END"


def _part(c: str, i: int) -> str:
    return f"CAST(split_part({c}, '-', {i}) AS INTEGER)"


_AGE = f"""CASE WHEN {_shaped('data_ent')} AND {_shaped('data_nasc')}
      AND {_part('data_nasc', 3)} BETWEEN 1900 AND 2000 THEN
      {_part('data_ent', 3)} - {_part('data_nasc', 3)}
      - CASE WHEN ({_part('data_ent', 2)}, {_part('data_ent', 1)}) < ({_part('data_nasc', 2)}, {_part('data_nasc', 1)})
             THEN 1 ELSE 0 END END"""

DER = f"""{ENC},
der_dates AS (SELECT *, {_date('data_ent')} AS ent, {_date('data_alta')} AS alta, substr(ID,1,2) AS prefix,
  CASE WHEN {_shaped('data_nasc')} THEN {_part('data_nasc', 3)} END AS birth_year, {_AGE} AS age FROM enc),
der AS (SELECT *, date_diff('day', ent, alta) AS days FROM der_dates)"""


def enc(body: str) -> str:
    return f"WITH {ENC}\n{body}"


def der(body: str) -> str:
    return f"WITH {DER}\n{body}"


# check, column, scope, failed, examples, value, number, against, rank key
_NULL = "NULL"
_CHECKS = [
    ("id_missing", "ID", "true", "ID IS NULL", 10, _NULL, _NULL, _NULL, "0"),
    ("id_pattern", "ID", "ID IS NOT NULL", "NOT regexp_full_match(ID, '[0-9]{3,5}')", 5, "ID", _NULL, _NULL, "0"),
    ("admission_missing", "data_ent", "true", "coalesce(data_ent, '') = ''", 10, _NULL, _NULL, _NULL, "0"),
    ("admission_format", "data_ent", "coalesce(data_ent, '') <> ''", f"NOT {_shaped('data_ent')}", 10, "data_ent", _NULL, _NULL, "0"),
    ("discharge_format", "data_alta", "coalesce(data_alta, '') <> ''", f"NOT {_shaped('data_alta')}", 10, "data_alta", _NULL, _NULL, "0"),
    ("birth_missing", "data_nasc", "true", "coalesce(data_nasc, '') = ''", 10, _NULL, _NULL, _NULL, "0"),
    ("birth_format", "data_nasc", "coalesce(data_nasc, '') <> ''", f"NOT {_shaped('data_nasc')}", 10, "data_nasc", _NULL, _NULL, "0"),
    ("year_mismatch", "data_ent", "ent IS NOT NULL AND coalesce(ID, '') <> ''", "strftime(ent, '%y') <> prefix", 20, "data_ent", "year(ent)", "prefix", "0"),
    ("admission_unparseable", "data_ent", f"coalesce(ID, '') <> '' AND {_shaped('data_ent')}", "ent IS NULL", 10, "data_ent", _NULL, _NULL, "0"),
    ("stay_unparseable", "data_alta", f"{_shaped('data_ent')} AND {_shaped('data_alta')}", "days IS NULL", 10, "data_alta", _NULL, "data_ent", "0"),
    ("discharge_before_admission", "data_alta", "days IS NOT NULL", "days < 0", 15, "data_alta", "days", "data_ent", "0"),
    ("long_stay", "data_alta", "days IS NOT NULL", "days > 60", 5, "data_alta", "days", "data_ent", "-days"),
    ("birth_too_old", "data_nasc", "birth_year IS NOT NULL", "birth_year < 1900", 10, "data_nasc", "birth_year", _NULL, "0"),
    ("birth_in_future", "data_nasc", "birth_year IS NOT NULL", "birth_year > 2000", 10, "data_nasc", "birth_year", _NULL, "0"),
    ("age_very_young", "data_nasc", "age IS NOT NULL", "age < 5", 5, "data_nasc", "age", "data_ent", "0"),
    ("age_very_old", "data_nasc", "age IS NOT NULL", "age > 100", 5, "data_nasc", "age", "data_ent", "0"),
    ("age_negative", "data_nasc", "age IS NOT NULL", "age < 0", 5, "data_nasc", "age", "data_ent", "0"),
    ("processo_missing", "processo", "true", "coalesce(processo, '') = ''", 10, _NULL, _NULL, _NULL, "0"),
    ("processo_invalid", "processo", "coalesce(processo, '') <> ''", "NOT regexp_full_match(processo, '[0-9 -]+')", 10, "processo", _NULL, _NULL, "0"),
    ("nome_missing", "nome", "true", "coalesce(nome, '') = ''", 10, _NULL, _NULL, _NULL, "0"),
    ("sexo_missing", "sexo", "true", "coalesce(sexo, '') = ''", 10, _NULL, _NULL, _NULL, "0"),
    ("destino_missing", "destino", "true", "coalesce(destino, '') = ''", 10, _NULL, _NULL, _NULL, "0"),
    ("origem_missing", "origem", "true", "coalesce(origem, '') = ''", 10, _NULL, _NULL, _NULL, "0"),
    ("sexo_unexpected", "sexo", "coalesce(sexo, '') <> ''", "sexo NOT IN ('M', 'F')", 10, "sexo", _NULL, _NULL, "0"),
]
_MISSING = [c[0] for c in _CHECKS if c[0].endswith("_missing")]


def _chosen(names):
    return [c for c in _CHECKS if not names or c[0] in names]


def _counts(*names: str) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{column}' AS "column", '{name}' AS "check",
  count(*) FILTER (WHERE {scope}) AS scope_count, count(*) FILTER (WHERE {scope} AND {failed}) AS failed_count,
  round(coalesce(count(*) FILTER (WHERE {scope} AND {failed}) / nullif(count(*) FILTER (WHERE {scope}), 0), 0), 6) AS failed_share
FROM der"""
        for name, column, scope, failed, *_ in _chosen(names)
    )


def _issues(*names: str) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{name}' AS "check", '{column}' AS "column", row_idx, ID AS id, CAST({value} AS VARCHAR) AS value,
  CAST({number} AS BIGINT) AS number, CAST({against} AS VARCHAR) AS against, CAST({key} AS BIGINT) AS rank_key,
  {k} AS wanted FROM der WHERE {scope} AND {failed}"""
        for name, column, scope, failed, k, value, number, against, key in _chosen(names)
    )


def counts(*names: str) -> str:
    return der(_counts(*names))


def issues(*names: str) -> str:
    return der(f"""SELECT "check", "column", row_idx, id, value, number, against, rank_key FROM ({_issues(*names)})""")


def examples(*names: str) -> str:
    return der(
        f"""SELECT "check", "column", CASE WHEN "check" = 'id_pattern' THEN min(row_idx) OVER (PARTITION BY "check", id) ELSE row_idx END AS row_idx,
  id, value, number, against, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY "check" ORDER BY rank_key, row_idx) AS INTEGER) AS rank
  FROM ({_issues(*names)})) WHERE rank <= wanted"""
    )


def _stats(kind: str, number: str, source: str) -> str:
    return f"""SELECT '{kind}' AS kind, count({number}) AS count, round(avg({number}), 6) AS mean,
  CAST(median({number}) AS DOUBLE) AS median, CAST(min({number}) AS BIGINT) AS min, CAST(max({number}) AS BIGINT) AS max FROM {source}"""


def _frequency(column: str, source: str) -> str:
    return f"""SELECT {column} AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM {source} WHERE coalesce({column}, '') <> '' GROUP BY {column}"""


def _sequence(group: str, number: str, source: str) -> str:
    missing = f"max({number}) - min({number}) + 1 - count(DISTINCT {number})"
    return f"""SELECT {group}, count(*) AS count, count({number}) > 0 AS valid, min({number}) AS min_serial, max({number}) AS max_serial,
  {missing} AS missing_count, round(({missing}) / (max({number}) - min({number}) + 1), 6) AS missing_share
FROM {source} GROUP BY {group}"""


def _gaps(group: str, number: str, source: str) -> str:
    return f"""SELECT {group}, CAST(n + 1 AS BIGINT) AS gap_start, CAST(nx - 1 AS BIGINT) AS gap_end, CAST(nx - n - 1 AS BIGINT) AS gap_len FROM (
  SELECT {group}, n, lead(n) OVER (PARTITION BY {group} ORDER BY n) AS nx
  FROM (SELECT DISTINCT {group}, {number} AS n FROM {source} WHERE {number} IS NOT NULL)) WHERE nx - n > 1"""


_SERIALS = """(SELECT substr(ID,1,2) AS year, TRY_CAST(nullif(ltrim(substr(ID,3),'0'),'') AS BIGINT) AS serial
  FROM enc WHERE ID IS NOT NULL)"""
_DUPLICATES = "(SELECT ID, count(*) AS n, min(row_idx) AS first_row FROM enc WHERE ID IS NOT NULL GROUP BY ID HAVING count(*) > 1)"


def _present(name: str) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS total_rows, count(*) FILTER (WHERE coalesce(CAST({c} AS VARCHAR), '') = '') AS missing_count,
  round(count(*) FILTER (WHERE coalesce(CAST({c} AS VARCHAR), '') = '') / count(*), 6) AS missing_share FROM {name}"""
        for c in _COLUMNS[name].split(", ")
    )


# Validation.


def _lenient(c: str) -> str:
    p = f"string_split({c}, '-')"
    year = f"CASE WHEN length({p}[3]) = 2 THEN concat('20', {p}[3]) ELSE {p}[3] END"
    return (
        f"CASE WHEN len({p}) = 3 THEN TRY_CAST(concat(lpad({year}, 4, '0'), '-', lpad({p}[2], 2, '0'), '-', "
        f"lpad({p}[1], 2, '0')) AS DATE) END"
    )


_NUMBER = "CASE WHEN regexp_full_match(trim(processo), '[+-]?[0-9]+([.]0*)?') THEN TRY_CAST(split_part(trim(processo), '.', 1) AS BIGINT) END"
_SEX = "CASE WHEN upper(trim(sexo)) IN ('M', 'F') THEN upper(trim(sexo)) END"

VAL = f"""{ENC},
typed AS (SELECT row_idx, ID, {_NUMBER} AS processo, nome, {_lenient('data_ent')} AS data_ent, {_lenient('data_alta')} AS data_alta,
  destino, {_SEX} AS sexo, {_lenient('data_nasc')} AS data_nasc, origem,
  processo IS NOT NULL AND ({_NUMBER}) IS NULL AS bad_number, data_ent AS raw_ent, data_alta AS raw_alta, data_nasc AS raw_nasc,
  sexo AS raw_sexo FROM enc),
val AS (SELECT *,
  concat_ws(',', CASE WHEN coalesce(ID,'')='' THEN 'id_missing' END, CASE WHEN nome IS NULL THEN 'nome_missing' END,
    CASE WHEN bad_number THEN 'processo_invalid' END) AS reasons,
  concat_ws(',', CASE WHEN coalesce(raw_ent,'')<>'' AND data_ent IS NULL THEN 'data_ent_unreadable' END,
    CASE WHEN coalesce(raw_alta,'')<>'' AND data_alta IS NULL THEN 'data_alta_unreadable' END,
    CASE WHEN coalesce(raw_nasc,'')<>'' AND data_nasc IS NULL THEN 'data_nasc_unreadable' END,
    CASE WHEN coalesce(raw_sexo,'')<>'' AND sexo IS NULL THEN 'sexo_unreadable' END) AS warnings,
  coalesce(length(ID) >= 2 AND TRY_CAST(substr(ID,1,2) AS INTEGER) BETWEEN 97 AND 99, false) AS in_97_99
  FROM typed)"""
_FIELDS = "row_idx, ID, processo, nome, data_ent, data_alta, destino, sexo, data_nasc, origem"


def val(body: str) -> str:
    return f"WITH {VAL}\n{body}"


def _json_value(expr: str, text: bool = True) -> str:
    quoted = f"""to_json({expr})::VARCHAR""" if text else f"CAST({expr} AS VARCHAR)"
    return f"coalesce(CASE WHEN {expr} IS NOT NULL THEN {quoted} END, 'null')"


def _json_fields() -> list[tuple[str, str]]:
    date = "strftime({}, '%d-%m-%Y')"
    return [
        ("_id", _json_value("ID")), ("processo", _json_value("processo", text=False)), ("nome", _json_value("nome")),
        ("data_ent", _json_value(date.format("data_ent"))), ("data_alta", _json_value(date.format("data_alta"))),
        ("destino", _json_value("destino")), ("sexo", _json_value("sexo")),
        ("data_nasc", _json_value(date.format("data_nasc"))), ("origem", _json_value("origem")),
    ]


def _json(pretty: bool = False) -> str:
    sep, gap = (",\n  ", " : ") if pretty else (",", ":")
    inner = f" || '{sep}' || ".join(f"""'"{k}"{gap}' || {v}""" for k, v in _json_fields())
    return f"'{{\n  ' || {inner} || '\n}}'" if pretty else f"'{{' || {inner} || '}}'"


# Tables, fingerprints.

_COLUMNS = {
    "region": "r_regionkey, r_name",
    "nation": "n_nationkey, n_name, n_regionkey",
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
    "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate",
    "events": "event_id, ts, user_id, event_type, value, props",
    "documents": "doc_id, text, lang, source, n_chars",
    "embeddings": "vec_id, embedding, label",
    "pages": "page_id, url, html",
    "benchmark": "item_id, text",
    "labels": "doc_id, quality, toxic",
    "conversations": "conv_id, turn, role, text",
}


def _shapes(extra: str = "") -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, {len(c.split(', '))} AS column_count, '{c}' AS columns{extra} FROM {t}"
        for t, c in _COLUMNS.items()
    )


def _table_sizes() -> str:
    def size(c: str) -> str:
        if c == "embedding":
            return "CASE WHEN embedding IS NULL THEN 0 ELSE len(embedding) * 8 END"
        return f"CASE WHEN {c} IS NULL THEN 0 WHEN typeof({c}) = 'VARCHAR' THEN length(CAST({c} AS VARCHAR)) ELSE 8 END"

    return "\nUNION ALL ".join(
        f"""SELECT 'joeira_{t}' AS table_name, count(*) AS row_count, CAST(sum(n) AS BIGINT) AS size, round(sum(n) / count(*), 6) AS avg_row_size
  FROM (SELECT {' + '.join(map(size, c.split(', ')))} AS n FROM {t})"""
        for t, c in _COLUMNS.items()
    )


def _profiles() -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{t}.parquet' AS file_name, CAST(1 AS BIGINT) AS files, count(*) AS row_count,
  {len(c.split(', '))} AS column_count, '{c}' AS columns FROM {t}"""
        for t, c in _COLUMNS.items()
    )


def _print(source: str, names: str, key: str | None) -> str:
    """Fingerprint of ``source``; ``names`` as in the table, ``key`` mixed in as the row number."""
    columns = names.split(", ")
    cells = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ([key] if key else []) + columns]
    return f"""SELECT row_count, {len(columns)} AS column_count,
  md5(concat_ws(':', '{','.join(columns)}', row_count, s2, s1, s0)) AS data_hash FROM (
  SELECT count(*) AS row_count, CAST(sum((w >> 40) & 1048575) AS BIGINT) AS s2, CAST(sum((w >> 20) & 1048575) AS BIGINT) AS s1,
    CAST(sum(w & 1048575) AS BIGINT) AS s0
  FROM (SELECT CAST('0x' || substr(md5(concat_ws('|', {', '.join(cells)})), 1, 15) AS BIGINT) AS w FROM {source}))"""


_BEFORE = {
    "documents": (_print("documents", "text, lang, source, n_chars", "doc_id"), "'7'"),
    "pages": (_print("pages", "url, html", "page_id"), "'first'"),
    "benchmark": (_print("benchmark", "text", "item_id"), "'12'"),
}
_NOW = {
    "documents": _print("(SELECT * FROM documents WHERE lang <> 'de')", "text, lang, source, n_chars", "doc_id"),
    "pages": _print(
        "(SELECT page_id, CASE WHEN page_id = 0 THEN 'moved' ELSE url END AS url, html FROM pages)", "url, html", "page_id"
    ),
    "benchmark": _print("benchmark", "text", "item_id"),
    "labels": _print("labels", "quality, toxic", "doc_id"),
}
_STATUS = f"""WITH old AS ({' UNION ALL '.join(
    f"SELECT '{s}' AS source_id, row_count, data_hash, {r} AS revision_id FROM ({q})" for s, (q, r) in _BEFORE.items())}),
new AS ({' UNION ALL '.join(f"SELECT '{s}' AS source_id, row_count, data_hash FROM ({q})" for s, q in _NOW.items())}),
status AS (SELECT new.source_id, old.source_id IS NULL AS first_time,
  old.source_id IS NOT NULL AND new.data_hash <> old.data_hash AS content_changed,
  old.row_count AS old_row_count, new.row_count, new.row_count - old.row_count AS row_delta,
  old.data_hash AS old_hash, new.data_hash, old.revision_id AS old_revision,
  CASE WHEN new.data_hash = old.data_hash THEN old.revision_id
       WHEN TRY_CAST(old.revision_id AS BIGINT) IS NOT NULL THEN CAST(CAST(old.revision_id AS BIGINT) + 1 AS VARCHAR)
       ELSE '1750000000' END AS revision_id
  FROM new LEFT JOIN old ON new.source_id = old.source_id)"""


def _metric(column: str, check: str, metric: str, value: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", '{check}' AS "check", '{metric}' AS metric, CAST({value} AS DOUBLE) AS value FROM {source}"""


def _findings() -> str:
    parts = [
        f"""SELECT "column", "check", unnest(['scope_count', 'failed_count', 'failed_share']) AS metric,
  unnest([CAST(scope_count AS DOUBLE), CAST(failed_count AS DOUBLE), failed_share]) AS value FROM ({_counts()})""",
        _metric("ID", "duplicates", "duplicate_rows", "coalesce(sum(n), 0)", _DUPLICATES),
        _metric("ID", "duplicates", "duplicate_keys", "count(*)", _DUPLICATES),
        _metric("ID", "duplicates", "duplicate_share", "round(coalesce(sum(n), 0) / (SELECT count(*) FROM enc), 6)", _DUPLICATES),
    ]
    for kind, column, number in (("stay", "data_alta", "days"), ("age", "data_nasc", "age")):
        for metric in ("count", "mean", "median", "min", "max"):
            parts.append(_metric(column, f"{kind}_stats", metric, metric, f"({_stats(kind, number, 'der')})"))
    for c in ("sexo", "destino", "origem"):
        parts.append(_metric(c, "frequency", "unique_count", f"count(DISTINCT nullif({c}, ''))", "enc"))
    return "\nUNION ALL ".join(parts)


_AGES = ("age_very_young", "age_very_old", "age_negative")
_FREQUENCIES = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS count, count(*) / sum(count(*)) OVER () AS share
FROM enc WHERE coalesce({c}, '') <> '' GROUP BY {c}""" for c in ("sexo", "destino", "origem")
)

# Report.


def _text_line(section: int, part: int, rank: str, text: str, source: str, where: str = "true") -> str:
    return f"SELECT {section} AS section, {part} AS part, CAST({rank} AS BIGINT) AS rank, {text} AS text FROM {source} WHERE {where}"


def _percent(part: str, whole: str) -> str:
    return f"printf('%.2f%%', coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0), 0) * 100)"


def _fixed_text(section: int, part: int, *texts: str, first: int = 0) -> list[str]:
    return [_text_line(section, part, str(i), f"'{t}'", "(SELECT 1)") for i, t in enumerate(texts, start=first)]


def _counted_line(section: int, part: int, label: str, check: str, none_line: bool, with_share: bool, rank: int = 0, dash: str = "- ") -> str:
    shown = f"concat('{dash}**{label}:** ', failed_count"
    shown += f", ' (', {_percent('failed_count', 'scope_count')}, ')')" if with_share else ")"
    text = f"CASE WHEN failed_count > 0 THEN {shown} ELSE '- **{label}:** None' END" if none_line else shown
    where = f""""check" = '{check}'""" + ("" if none_line else " AND failed_count > 0")
    return _text_line(section, part, str(rank), text, "counted", where)


def _shown(section: int, part: int, check: str, text: str) -> str:
    return _text_line(section, part, "rank", text, "shown", f""""check" = '{check}' AND rank <= 3""")


def _report(years: bool = False) -> str:
    """``years``: only 1997 to 1999, with a file profile that has a name but no size."""
    who = "'  - ID ''', coalesce(id, ''), ''''"
    dated, valued = f"concat({who}, ' has date ''', value, '''')", f"concat({who}, ' has value ''', value, '''')"
    columns = "ID, processo, nome, data_ent, data_alta, destino, sexo, data_nasc, origem"
    out = _fixed_text(0, 0, "# Quality Control Report - 2000-06-30 00:00", "", "**File:** orders", "")
    if years:
        out += _fixed_text(0, 0, "**Filter:** Showing records from years 2099 to 2097", first=4)
        kept = _percent("(SELECT count(*) FROM enc)", "(SELECT count(*) FROM orders)").replace("%.2f", "%.1f")
        out.append(_text_line(0, 0, "5", f"""concat('**Records:** ', format('{{:,}}', (SELECT count(*) FROM enc)), ' of ',
  format('{{:,}}', (SELECT count(*) FROM orders)), ' total (', {kept}, ')')""", "(SELECT 1)"))
    else:
        out += _fixed_text(0, 0, "**Scope:** Full database (no filters applied)", first=5)
    out += _fixed_text(1, 0, "", "## File Analysis", "")
    if years:
        out += _fixed_text(1, 0, "- **File Name:** orders.parquet", "- **File Path:** orders", "- **File Size:** 0.00 KB", first=3)
    more = 3 if years else 0
    out.append(_text_line(1, 0, str(3 + more), "concat('- **Total Rows:** ', (SELECT count(*) FROM enc))", "(SELECT 1)"))
    out += _fixed_text(1, 0, "- **Total Columns:** 9", "", f"**Columns:** {columns}", first=4 + more)
    titles = ["ID", "Admission Date", "Discharge Date", "Birth Date", "Processo", "Nome", "Sexo", "Destino", "Origem"]
    for section, title in enumerate(titles, start=2):
        out += _fixed_text(section, 0, "", f"## {title} Analysis", "")
    missing = {
        2: ("id_missing", "IDs"), 3: ("admission_missing", "Dates"), 5: ("birth_missing", "Dates"),
        6: ("processo_missing", "Values"), 7: ("nome_missing", "Values"), 8: ("sexo_missing", "Values"),
        9: ("destino_missing", "Values"), 10: ("origem_missing", "Values"),
    }
    for section, (check, what) in missing.items():
        out.append(_counted_line(section, 1, f"Missing {what}", check, True, True))
        out.append(
            f"""SELECT {section}, 2, CAST(1 AS BIGINT), concat('  - Examples: Rows ', string_agg(CAST(row_idx + 2 AS VARCHAR), ', ' ORDER BY rank))
FROM shown WHERE "check" = '{check}' AND rank <= 5 HAVING count(*) > 0"""
        )
    # IDs
    out.append(
        f"""SELECT 2, 3, CAST(0 AS BIGINT), CASE WHEN count(*) = 0 THEN '- **Duplicate IDs:** None'
  ELSE concat('- **Duplicate IDs:** ', CAST(sum(n) AS BIGINT), ' (', {_percent('sum(n)', '(SELECT count(*) FROM enc)')}, ')') END FROM {_DUPLICATES}"""
    )
    out.append(
        f"""SELECT 2, 4, place * 1125899906842624 + row_idx, concat('  - ID ''', d.ID, ''' in row ', row_idx + 2) FROM enc
  JOIN (SELECT *, row_number() OVER (ORDER BY first_row) AS place FROM (SELECT * FROM {_DUPLICATES} ORDER BY first_row LIMIT 3)) d ON enc.ID = d.ID"""
    )
    out += _fixed_text(
        2, 5, "", "**ID Sequence Analysis by Year:**", "| Year | Count | Min Serial | Max Serial | Missing Values |",
        "|------|-------|------------|------------|----------------|",
    )
    out.append(
        f"""SELECT 2, 9, CAST(ascii(year) AS BIGINT) * 1200000 + ascii(substr(year, 2, 1)), concat('| ', year, ' | ', count, ' | ',
  coalesce(CAST(min_serial AS VARCHAR), 'N/A'), ' | ', coalesce(CAST(max_serial AS VARCHAR), 'N/A'), ' | ', coalesce(missing_count, 0), ' |')
FROM ({_sequence('year', 'serial', _SERIALS)})"""
    )
    out += _fixed_text(2, 10, "", "**ID Pattern Consistency:**")
    bad = "CASE WHEN failed_count > 0 THEN concat('- Invalid IDs: ', failed_count) ELSE '- All IDs follow the expected pattern.' END"
    out.append(_text_line(2, 10, "2", bad, "counted", """"check" = 'id_pattern'"""))
    out.append(_shown(2, 11, "id_pattern", f"concat({who}, ' in row ', first_row + 2)"))
    # dates
    for section, label in ((3, "admission"), (4, "discharge"), (5, "birth")):
        out.append(_counted_line(section, 3, "Invalid Date Formats", f"{label}_format", True, False))
        out.append(_shown(section, 4, f"{label}_format", dated))
    pair = f"concat({who}, ' has admission ''', against, ''' and discharge ''', value, '''')"
    for section, part, label, check, text in (
        (4, 5, "Chronology Errors", "discharge_before_admission", pair),
        (5, 5, "Unusually Old Dates", "birth_too_old", dated),
        (5, 7, "Future Dates", "birth_in_future", dated),
    ):
        out.append(_counted_line(section, part, label, check, False, False))
        out.append(_shown(section, part + 1, check, text))
    ages = [
        "''", "'**Age Statistics:**'", "printf('- Mean Age: %.1f', avg(age))",
        "printf('- Median Age: %.1f', CAST(median(age) AS DOUBLE))", "concat('- Min Age: ', min(age))", "concat('- Max Age: ', max(age))",
    ]
    out += [f"SELECT 5, 10, CAST({i} AS BIGINT), {t} FROM der HAVING count(age) > 0" for i, t in enumerate(ages)]
    # values
    out.append(_counted_line(6, 3, "Invalid Values", "processo_invalid", True, True))
    out.append(_shown(6, 4, "processo_invalid", valued))
    for section, c in ((8, "sexo"), (9, "destino"), (10, "origem")):
        out += [
            f"SELECT {section}, 3, CAST({i} AS BIGINT), '{t}' FROM enc HAVING count(nullif({c}, '')) > 0"
            for i, t in enumerate(("", "**Value Frequencies:**"))
        ]
        out.append(
            f"""SELECT {section}, 4, -count(*), concat('- ', {c}, ': ', count(*), ' (', {_percent('count(*)', 'sum(count(*)) OVER ()')}, ')')
FROM enc WHERE coalesce({c}, '') <> '' GROUP BY {c}"""
        )
    out.append(_text_line(8, 10, "0", "''", "counted", """"check" = 'sexo_unexpected' AND failed_count > 0"""))
    out.append(_counted_line(8, 10, "Unexpected Values", "sexo_unexpected", False, True, 1, dash=""))
    out.append(_shown(8, 11, "sexo_unexpected", valued))
    lines = "\nUNION ALL ".join(out)
    tables = DER
    if years:
        tables = DER.replace("\nenc AS (", "\nenc_all AS (", 1).replace(
            "FROM enc_days)", "FROM enc_days),\nenc AS (SELECT * FROM enc_all WHERE regexp_matches(ID, '^[0-9]{2}') AND TRY_CAST(substr(ID,1,2) AS INT) BETWEEN 97 AND 99)", 1
        )
    return f"""WITH {tables}, counted AS ({_counts()}),
shown AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY rank_key, row_idx) AS rank,
  min(row_idx) OVER (PARTITION BY "check", id) AS first_row FROM ({_issues()}))
SELECT section, part, rank, text FROM ({lines})"""


_CELLS = ["ID", "processo", "nome", "data_ent", "data_alta", "destino", "sexo", "data_nasc", "origem"]


def _csv_line(n: int) -> str:
    return " || ',' || ".join(f"CASE WHEN {c} = '' THEN '\"\"' ELSE coalesce({c}, '') END" for c in _CELLS[:n])


# How many cells a line has; what is behind the end is not there, what is blank is read as null.
_N_CELLS = "CASE WHEN row_idx % 43 = 0 THEN 2 WHEN row_idx % 13 = 0 THEN 7 WHEN row_idx % 17 = 0 THEN 10 ELSE 9 END"
_LINE = f"""CASE WHEN row_idx % 43 = 0 THEN {_csv_line(2)} WHEN row_idx % 13 = 0 THEN {_csv_line(7)}
  WHEN row_idx % 17 = 0 THEN {_csv_line(9)} || ',more' ELSE {_csv_line(9)} END"""
_READ = ", ".join(f"CASE WHEN {_N_CELLS} > {i} THEN nullif({c}, '') END AS {c}" for i, c in enumerate(_CELLS))
# Validation cannot tell a blank cell from none, so on a line of the right length it counts as empty.
_FILLED = ", ".join(
    f"CASE WHEN {_N_CELLS} = 9 THEN coalesce({c}, '') WHEN {_N_CELLS} > {i} THEN nullif({c}, '') END AS {c}"
    for i, c in enumerate(_CELLS) if c in ("processo", "nome", "destino")
)
_REASONS = f"""concat_ws(',', CASE WHEN coalesce(ID, '') = '' THEN 'id_missing' END, CASE WHEN nome IS NULL THEN 'nome_missing' END,
  CASE WHEN processo IS NOT NULL AND {_NUMBER} IS NULL THEN 'processo_invalid' END)"""

EXPECTED_SQL: dict[str, str] = {
    "csv_lines": enc(f"SELECT row_idx, {_LINE} AS line FROM enc"),
    "csv_cells": enc(f"SELECT row_idx, {_READ}, {_N_CELLS} <> 9 AS wrong_length FROM enc"),
    "csv_validated": enc(
        f"""SELECT row_idx, ID, nome, {_NUMBER} AS processo, destino, {_REASONS} AS reasons FROM (
  SELECT row_idx, ID, {_FILLED} FROM enc)"""
    ),
    "json_lines": enc(
        f"""SELECT *, CAST(length(to_json({{{', '.join(f"'{c}': {c}" for c in _CELLS)}}})::VARCHAR) AS INTEGER) AS json_chars FROM enc"""
    ),
    "encounters": enc("SELECT * FROM enc"),
    "year_filter_single": enc("SELECT * FROM enc WHERE ID LIKE '99%'"),
    "year_filter_range": enc(
        "SELECT * FROM enc WHERE regexp_matches(ID, '^[0-9]{2}') AND TRY_CAST(substr(ID,1,2) AS INT) BETWEEN 97 AND 99"
    ),
    "year_filter_patients": enc(
        "SELECT row_idx, ID, TRY_CAST(substr(ID,1,2) AS INTEGER) AS year FROM enc WHERE length(ID) >= 2 AND TRY_CAST(substr(ID,1,2) AS INT) BETWEEN 0 AND 1"
    ),
    "year_filter_summary": enc(
        """SELECT true AS is_filtered, 'range' AS filter_type, '2099 to 2097' AS filter_value, count(*) AS total_records,
  count(*) FILTER (WHERE TRY_CAST(substr(ID,1,2) AS INT) BETWEEN 97 AND 99) AS filtered_records,
  round(count(*) FILTER (WHERE TRY_CAST(substr(ID,1,2) AS INT) BETWEEN 97 AND 99) / count(*), 6) AS kept_share FROM enc"""
    ),
    "patients_over_50": der("SELECT row_idx, ID, age FROM der WHERE age > 50"),
    "missing_values": counts(*_MISSING),
    "missing_values_customer": _present("customer"),
    "missing_values_documents": _present("documents"),
    "missing_rows": issues("id_missing", "admission_missing", "birth_missing"),
    "id_pattern": counts("id_pattern"),
    "id_pattern_examples": der(
        f"""SELECT rank, e.id, (SELECT min(row_idx) FROM enc WHERE enc.ID = e.id) AS first_row FROM (
  SELECT id, CAST(row_number() OVER (ORDER BY row_idx) AS INTEGER) AS rank FROM ({_issues('id_pattern')})) e WHERE rank <= 5"""
    ),
    "id_year_prefixes": enc(
        "SELECT DISTINCT substr(ID,1,2) AS prefix, TRY_CAST(substr(ID,1,2) AS INTEGER) AS year FROM enc WHERE ID IS NOT NULL"
    ),
    "id_year_outliers": enc(
        """SELECT prefix, year, CASE WHEN year > 26 THEN 'future' ELSE 'very_old' END AS kind FROM (
  SELECT DISTINCT substr(ID,1,2) AS prefix, TRY_CAST(substr(ID,1,2) AS INTEGER) AS year FROM enc) WHERE year > 26 OR year < 15"""
    ),
    "duplicate_ids": enc(f"SELECT * FROM {_DUPLICATES}"),
    "duplicate_id_rows": enc(
        f"SELECT d.ID, n, first_row, row_idx, row_idx + 2 AS line_no FROM enc JOIN {_DUPLICATES} d ON enc.ID = d.ID"
    ),
    "duplicate_summary": enc(
        f"""SELECT (SELECT count(*) FROM enc) AS total_rows, CAST(sum(n) AS BIGINT) AS duplicate_rows, count(*) AS duplicate_keys,
  round(sum(n) / (SELECT count(*) FROM enc), 6) AS duplicate_share FROM {_DUPLICATES}"""
    ),
    "first_duplicates": enc(
        f"""SELECT d.ID, n, first_row, string_agg(CAST(row_idx + 2 AS VARCHAR), ', ' ORDER BY row_idx) AS lines, n - count(*) AS n_more FROM (
  SELECT ID, row_idx, row_number() OVER (PARTITION BY ID ORDER BY row_idx) AS r FROM enc) e
  JOIN (SELECT * FROM {_DUPLICATES} ORDER BY first_row LIMIT 3) d ON e.ID = d.ID WHERE r <= 10 GROUP BY d.ID, n, first_row"""
    ),
    "duplicate_conversations": "SELECT conv_id, count(*) AS n, min(turn) AS first_row FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "distinct_ids": enc("SELECT DISTINCT ID FROM enc"),
    "id_sequences": enc(_sequence("year", "serial", _SERIALS)),
    "serial_gaps": enc(_gaps("year", "serial", _SERIALS)),
    "missing_serials": enc(
        f"""SELECT r.year, r.s AS missing_serial FROM (SELECT year, unnest(range(min(serial), max(serial) + 1)) AS s FROM {_SERIALS} GROUP BY year) r
  ANTI JOIN {_SERIALS} x ON r.year = x.year AND r.s = x.serial"""
    ),
    "missing_serials_preview": enc(
        f"""SELECT year, concat(array_to_string(list(s ORDER BY s)[1:5], ', '), CASE WHEN count(*) > 5 THEN concat(', ... (', count(*) - 5, ' more)') ELSE '' END) AS missing_text,
  count(*) AS missing_count, greatest(count(*) - 5, 0) AS n_more FROM (
  SELECT r.year, r.s FROM (SELECT year, unnest(range(min(serial), max(serial) + 1)) AS s FROM {_SERIALS} GROUP BY year) r
  ANTI JOIN {_SERIALS} x ON r.year = x.year AND r.s = x.serial) GROUP BY year"""
    ),
    "turn_sequences": _sequence("conv_id", "turn", "conversations"),
    "line_sequences": _sequence("l_orderkey", "l_linenumber", "lineitem"),
    "line_gaps": _gaps("l_orderkey", "l_linenumber", "lineitem"),
    "missing_lines": """SELECT r.l_orderkey, CAST(r.s AS BIGINT) AS missing_serial FROM (
  SELECT l_orderkey, unnest(range(min(l_linenumber), max(l_linenumber) + 1)) AS s FROM lineitem GROUP BY l_orderkey) r
  ANTI JOIN lineitem x ON r.l_orderkey = x.l_orderkey AND r.s = x.l_linenumber""",
    "date_format_check": counts("admission_format", "discharge_format", "birth_format"),
    "date_format_examples": examples("admission_format", "discharge_format", "birth_format"),
    "date_pairs": counts("admission_unparseable", "stay_unparseable"),
    "impossible_dates": issues("admission_unparseable", "stay_unparseable"),
    "parsed_dates": der(
        "SELECT row_idx, ent AS admission, alta AS discharge, strftime(ent, '%d-%m-%Y') AS admission_text, strftime(ent, '%y') AS year_suffix FROM der"
    ),
    "year_consistency": counts("year_mismatch"),
    "year_mismatch_rows": issues("year_mismatch"),
    "year_mismatch_examples": examples("year_mismatch"),
    "chronology": counts("discharge_before_admission"),
    "chronology_examples": examples("discharge_before_admission"),
    "stay_days": der("SELECT row_idx, CAST(days AS INTEGER) AS days FROM der"),
    "stay_stats": der(_stats("stay", "days", "der")),
    "ship_lag_stats": _stats(
        "ship_lag", "days",
        "(SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    ),
    "long_stay_count": counts("long_stay"),
    "long_stays": examples("long_stay"),
    "birth_validity": counts("birth_too_old", "birth_in_future"),
    "birth_validity_examples": examples("birth_too_old", "birth_in_future"),
    "age_at_admission": der("SELECT row_idx, age FROM der"),
    "age_stats": der(_stats("age", "age", "der")),
    "age_histogram": der(
        """SELECT decade, concat(decade, '-', decade + 9) AS label, count(*) AS count FROM (
  SELECT CAST(trunc(age / 10) * 10 AS INTEGER) AS decade FROM der WHERE age IS NOT NULL) GROUP BY decade"""
    ),
    "unusual_ages": counts(*_AGES),
    "unusual_age_examples": examples(*_AGES),
    "processo_invalid": counts("processo_invalid"),
    "processo_invalid_examples": examples("processo_missing", "processo_invalid"),
    "value_frequency_sexo": enc(_frequency("sexo", "enc")),
    "value_frequency_destino": enc(_frequency("destino", "enc")),
    "value_frequency_origem": enc(_frequency("origem", "enc")),
    "value_frequencies": enc(_FREQUENCIES),
    "event_type_frequency": _frequency("event_type", "events"),
    "lang_frequency": _frequency("lang", "documents"),
    "unexpected_values": counts("sexo_unexpected"),
    "unexpected_value_rows": issues("sexo_unexpected"),
    "check_examples": examples(),
    "issues": issues(),
    "findings": der(_findings()),
    "report_lines": _report(),
    "report_filtered": _report(years=True),
    "pad_ids": enc(
        "SELECT row_idx, CASE WHEN length(processo) < 4 THEN lpad(processo, 4, '0') ELSE processo END AS padded FROM enc"
    ),
    "id_parts": enc(
        """SELECT row_idx, TRY_CAST(substr(ID,1,2) AS INTEGER) AS year,
  TRY_CAST(nullif(ltrim(substr(ID,3),'0'),'') AS BIGINT) AS serial FROM enc"""
    ),
    "parse_dates_lenient": enc(
        f"SELECT row_idx, {_lenient('data_ent')} AS data_ent, {_lenient('data_alta')} AS data_alta, {_lenient('data_nasc')} AS data_nasc FROM enc"
    ),
    "normalise_sex": enc(f"SELECT row_idx, {_SEX} AS sexo FROM enc"),
    "parse_record_no": enc(
        f"SELECT row_idx, {_NUMBER} AS number, nullif(regexp_replace(processo, '[^0-9]', '', 'g'), '') AS digits FROM enc"
    ),
    "safe_names": "SELECT p_partkey, replace(replace(p_name, ' ', '_'), '/', '_') AS safe_name FROM part",
    "na_values": enc(
        "SELECT row_idx, nullif(data_ent, '') AS data_ent, nullif(nullif(sexo, 'F'), '') AS sexo, nullif(nome, '') AS nome FROM enc"
    ),
    "row_numbers": "SELECT row_number() OVER () - 1 AS row_idx, event_id FROM events",
    "validated_patients": val(f"SELECT {_FIELDS}, warnings FROM val WHERE reasons = ''"),
    "rejected_patients": val("SELECT row_idx, ID, nome, reasons FROM val WHERE reasons <> '' AND coalesce(ID,'')<>'' AND nome IS NOT NULL"),
    "rejected_patients_filtered": val(
        "SELECT row_idx, ID, nome, reasons FROM val WHERE in_97_99 AND reasons <> '' AND coalesce(ID,'')<>'' AND nome IS NOT NULL"
    ),
    "skipped_patients_filtered": val(
        """SELECT row_idx, ID, nome, coalesce(in_97_99, false) AS in_filter, reasons FROM val
  WHERE NOT coalesce(in_97_99 AND coalesce(ID,'')<>'' AND nome IS NOT NULL, false)"""
    ),
    "validation_counts": val(
        """SELECT total, total - filtered AS skipped, filtered, processed, filtered - processed AS errors, with_warnings FROM (
  SELECT count(*) AS total, count(*) FILTER (WHERE in_97_99 AND coalesce(ID,'')<>'' AND nome IS NOT NULL) AS filtered,
    count(*) FILTER (WHERE in_97_99 AND reasons = '') AS processed, count(*) FILTER (WHERE warnings <> '') AS with_warnings FROM val)"""
    ),
    "written_documents": val("SELECT count(DISTINCT ID) AS written FROM val WHERE reasons = ''"),
    "latest_per_id": val(
        f"SELECT {_FIELDS} FROM val WHERE reasons = '' QUALIFY row_number() OVER (PARTITION BY ID ORDER BY row_idx DESC) = 1"
    ),
    "patient_json": val(f"SELECT row_idx, {_json()} AS json FROM val WHERE reasons = ''"),
    "preview_record": val(
        f"""SELECT row_idx, ID, {_json(pretty=True)} AS json FROM val
  WHERE coalesce(ID,'')<>'' AND nome IS NOT NULL AND TRY_CAST(substr(ID,1,2) AS INT) = 99 ORDER BY row_idx LIMIT 1"""
    ),
    "table_shapes": _shapes(),
    "table_stats": _table_sizes(),
    "table_stats_all": _table_sizes(),
    "table_profile": _profiles(),
    "catalog_lookup": _shapes(", true AS known, true AS listed"),
    "sheet_list": "SELECT unnest([" + ", ".join(f"'{t}'" for t in _COLUMNS) + "]) AS sheet_name, 'parquet' AS format, CAST(1 AS BIGINT) AS files",
    "fingerprint_documents": _print("documents", "text, lang, source, n_chars", "doc_id"),
    "fingerprint_conversations": _print("conversations", "conv_id, turn, role, text", None),
    "fingerprint_encounters": enc(
        _print("enc", "ID, processo, nome, data_ent, data_alta, destino, sexo, data_nasc, origem", "row_idx")
    ),
    "change_status": f"{_STATUS} SELECT * FROM status",
    "revision_info": f"{_STATUS} SELECT source_id, row_count, data_hash, revision_id FROM status",
}

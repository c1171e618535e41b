"""DuckDB SQL for the registered queries, written from the rules, not from the engine.

`MESSY`, `REPLIES`, `LOADS` and `RAGGED` are plain SQL that both engines run: they derive the
query inputs from the given tables. The rest is composed from small SQL snippets.
"""

from __future__ import annotations

COLUMNS = ["order_id", "priority", "total", "order_date", "filled", "notes"]

# --- inputs, run by Spark and DuckDB alike ----------------------------------------------

MESSY = """
with base as (
  select o_orderkey as k, o_orderstatus as st, o_totalprice as p, o_orderdate as d, o_orderpriority as pr
  from orders
),
m as (
  select k as row_id,
    cast(k as varchar(20)) as order_id,
    case when k % 23 = 0 then 'n/a' when k % 11 = 0 then concat(' ', lower(pr), ' ')
         when k % 7 = 0 then lower(pr) else pr end as priority,
    case when k % 13 = 0 then 'N/A' when k % 17 = 0 then '-' when k % 19 = 0 then null
         when k % 29 = 0 then concat(cast(cast(p as decimal(18,2)) as varchar(30)), ' USD')
         when k % 101 = 0 then cast(cast(p * 50 as decimal(18,2)) as varchar(30))
         else cast(cast(p as decimal(18,2)) as varchar(30)) end as total,
    case when k % 31 = 0 then '?' when k % 37 = 0 then 'not a date'
         when k % 2 = 0 then cast(cast(d as date) as varchar(10))
         else concat(cast(month(d) as varchar(2)), '/', cast(day(d) as varchar(2)), '/', cast(year(d) as varchar(4))) end as order_date,
    case when k % 41 = 0 then 'maybe' when st = 'F' then 'Yes' when st = 'O' then 'no' else '1' end as filled,
    case when k % 2 = 0 then '' else null end as notes
  from base
)
select * from m
union all
select row_id + 1000000000, order_id, priority, total, order_date, filled, notes from m where row_id % 50 = 0
"""

_OP = (
    "case c_custkey % 6 when 0 then 'remove_duplicates' when 1 then 'fill_missing' "
    "when 2 then 'normalize_text' when 3 then 'convert_type' when 4 then 'remove_outlier_rows' "
    "else 'drop_table' end"
)
_COL = (
    "case c_custkey % 5 when 0 then 'total' when 1 then 'priority' when 2 then 'order_date' "
    "when 3 then 'filled' else 'nowhere' end"
)
_STRATEGY = (
    "case c_custkey % 11 when 0 then 'last' when 1 then 'mean' when 2 then 'median' when 3 then 'zero' "
    "when 4 then 'trim_titlecase' when 5 then 'UPPER' when 6 then 'date' when 7 then 'boolean' "
    "when 8 then 'unknown' when 9 then 'leave' else 'custom text' end"
)
_ITEM = f"""concat('{{"title":"', case when c_custkey % 13 = 0 then repeat(c_name, 6) else c_name end,
  '","reason":"balance ', cast(c_nationkey as varchar(9)), '","operationType":"', {_OP}, '","column":"', {_COL},
  '","strategy":"', {_STRATEGY}, '"',
  case c_custkey % 4 when 0 then ',"confidence":2' when 1 then ',"confidence":0.25'
                     when 2 then ',"confidence":"high"' else '' end, '}}')"""
_BODY = f"""concat('{{"insights":[{{"title":"', c_mktsegment, '","description":"', c_name, '"}},{{"title":7,"description":"x"}}],',
  '"suggestions":[', {_ITEM}, ',{{"title":"no reason","operationType":"fill_missing"}}]}}')""".replace("{{", "{").replace("}}", "}")
REPLIES = f"""
select 'messy_orders' as dataset, cast(c_custkey as bigint) as reply_id,
  case c_custkey % 7 when 1 then concat('```json\n', {_BODY}, '\n```')
                     when 2 then concat('Here you go: ', {_BODY}, ' Done.')
                     when 3 then concat('Sorry, no answer for ', c_name)
                     when 4 then concat('  ', {_BODY}, '\n')
                     else {_BODY} end as reply
from customer
"""

LOADS = """
select concat('dataset_', cast(o_custkey % 40 as varchar(9))) as name,
  cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as file_size,
  cast(o_orderkey as bigint) as row_count, cast(o_custkey % 12 as bigint) as column_count,
  cast(cast(o_orderdate as date) as varchar(10)) as loaded_at
from orders
"""

# rows that are short (every third), or too wide (every third)
RAGGED = """
select case when o_orderkey % 3 = 0 then concat(cast(o_orderkey as varchar(20)), ',', o_orderstatus)
            when o_orderkey % 3 = 1 then concat(cast(o_orderkey as varchar(20)), ',', o_orderstatus, ',', o_orderpriority, ',extra,more')
            else concat(cast(o_orderkey as varchar(20)), ',', o_orderstatus, ',', o_orderpriority) end as value
from orders
"""

# --- snippets -----------------------------------------------------------------------------

_WS = "".join(
    f"chr({n})||"
    for n in [9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279]
)[:-2]


def trimmed(c: str) -> str:
    return f"trim({c}, {_WS})"


def norm(c: str) -> str:
    return f"lower({trimmed(c)})"


def missing(c: str) -> str:
    return f"({c} is null or {norm(c)} in ('','n/a','na','null','nil','-','—','.','?'))"


def is_number(c: str) -> str:
    return (
        f"regexp_full_match({trimmed(c)}, '-?[0-9]{{1,3}}(,[0-9]{{3}})*([.][0-9]+)?') "
        f"or regexp_full_match({trimmed(c)}, '-?[0-9]+([.][0-9]+)?')"
    )


def prefix_number(c: str) -> str:
    return (
        f"try_cast(nullif(regexp_extract(replace({trimmed(c)}, ',', ''), "
        "'^[+-]?([0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?|[.][0-9]+([eE][+-]?[0-9]+)?)'), '') as double)"
    )


def whole_number(c: str) -> str:
    return (
        f"case when not {missing(c)} and regexp_full_match({trimmed(c)}, "
        f"'[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast({trimmed(c)} as double) end"
    )


def date_of(c: str) -> str:
    t = trimmed(c)
    return (
        f"case when regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') then try_strptime({t}, '%Y-%m-%d') "
        f"when regexp_full_match({t}, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}') then try_strptime({t}, '%Y/%m/%d') "
        f"when regexp_full_match({t}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') then try_strptime({t}, '%m/%d/%Y') "
        f"when regexp_full_match({t}, '[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}') then try_strptime({t}, '%m-%d-%Y') "
        f"when regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}') then try_cast({t} as timestamp) end"
    )


def title(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '[A-Za-z0-9_][^ \\t\\n\\r]*|[^A-Za-z0-9_]+'), "
        "lambda w: case when regexp_matches(w, '^[A-Za-z0-9_]') then upper(w[1]) || lower(w[2:]) else w end), '')"
    )


def number_text(x: str) -> str:
    return f"regexp_replace(cast({x} as varchar), '[.]0$', '')"


def bool_word(c: str) -> str:
    return f"case when {norm(c)} in ('true','yes','1') then 'true' when {norm(c)} in ('false','no','0') then 'false' end"


def half_up(x: str, digits: int) -> str:
    s = 10**digits
    return f"floor({x} * {s} + 0.5) / {s}"


def row_key(alias: str = "") -> str:
    dot = f"{alias}." if alias else ""
    return ", ".join(f"coalesce({dot}{c}, '')" for c in COLUMNS)


def any_missing() -> str:
    return "(" + " or ".join(missing(c) for c in COLUMNS) + ")"


# --- shared steps: cells, counters, types, numbers of the messy orders -----------------------

_CELLS = " union all ".join(
    f"select {i} as ord, '{c}' as col, row_id, {c} as value from messy" for i, c in enumerate(COLUMNS, 1)
)
PRELUDE = f"""with messy as ({MESSY}),
cells as ({_CELLS}),
freq as (select ord, col, value, count(*) as cnt from cells group by all),
facts as (
  select *, {missing('value')} as miss from freq
),
counters as (
  select ord, col, cast(sum(cnt) as bigint) as row_count,
    cast(sum(case when miss then cnt else 0 end) as bigint) as missing_count,
    cast(sum(case when miss then 0 else cnt end) as bigint) as total_values,
    cast(count(*) filter (where not miss) as bigint) as unique_count,
    cast(coalesce(sum(cnt) filter (where not miss and {norm('value')} in ('true','yes','1')), 0) as bigint) as true_count,
    cast(coalesce(sum(cnt) filter (where not miss and {norm('value')} in ('false','no','0')), 0) as bigint) as false_count,
    coalesce(sum(cnt) filter (where not miss and {date_of('value')} is not null), 0) as date_like,
    coalesce(sum(cnt) filter (where not miss and ({is_number('value')})), 0) as number_like,
    min({date_of('value')}) filter (where not miss) as first_ts,
    max({date_of('value')}) filter (where not miss) as last_ts
  from facts group by all
),
types as (
  select *, case when total_values = 0 then 'unknown'
    when (true_count + false_count) / total_values >= 0.8 then 'boolean'
    when date_like / total_values >= 0.8 then 'date'
    when number_like / total_values >= 0.8 then 'number' else 'text' end as inferred_type
  from counters
),
nums as (
  select c.col, c.row_id, {prefix_number('c.value')} as x
  from cells c join types t on c.col = t.col
  where t.inferred_type = 'number' and not {missing('c.value')} and {prefix_number('c.value')} is not null
),
quarts as (
  select col, count(*) as n, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from nums group by col
),
fence as (
  select col, q1 - 1.5 * (q3 - q1) as lower, q3 + 1.5 * (q3 - q1) as upper from quarts where n >= 4 and q3 <> q1
),
outl as (
  select q.col, cast(count(n.x) filter (where n.x < f.lower or n.x > f.upper) as bigint) as outlier_count
  from quarts q left join fence f on q.col = f.col left join nums n on n.col = q.col group by q.col
),
texts as (
  select f.col, f.value, f.cnt, t.row_count, {norm('f.value')} as normal_form, {trimmed('f.value')} as spelling
  from facts f join types t on f.col = t.col where t.inferred_type = 'text' and not f.miss
),
spelled as (
  select col, normal_form, spelling, cast(sum(cnt) as bigint) as count from texts group by all
),
forms as (
  select col, normal_form, count(*) as n_spellings from spelled group by all having count(*) >= 2
),
incons as (
  select col, cast(count(*) as bigint) as inconsistent_groups,
    cast(sum(n_spellings) as bigint) as inconsistent_spellings from forms group by col
),
ranked as (
  select *, row_number() over (partition by col order by cnt desc, value collate en, value) as place,
    rank() over (partition by col order by cnt desc) as rk from texts
),
numstats as (
  select col, cast(count(*) as bigint) as num_count, sum(x) as sum, avg(x) as mean, quantile_cont(x, 0.5) as median,
    min(x) as min, max(x) as max, max(x) - min(x) as range, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3,
    quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr, var_pop(x) as variance, stddev_pop(x) as std_dev,
    quantile_cont(x, 0.1) as p10, quantile_cont(x, 0.9) as p90, quantile_cont(x, 0.95) as p95, quantile_cont(x, 0.99) as p99
  from nums group by col
),
prof as (
  select t.ord as ordinal, t.col as name, t.inferred_type, t.total_values, t.missing_count, t.unique_count,
    case when t.total_values > 0 then t.unique_count / t.total_values else 0.0 end as unique_ratio,
    t.total_values = 0 as is_empty, t.row_count, t.true_count, t.false_count, t.first_ts, t.last_ts,
    coalesce(i.inconsistent_groups, 0) as inconsistent_groups,
    coalesce(i.inconsistent_spellings, 0) as inconsistent_spellings, coalesce(o.outlier_count, 0) as outlier_count
  from types t left join incons i on t.col = i.col left join outl o on t.col = o.col
),
copies as (select {row_key()}, count(*) as n from messy group by all),
totals as (
  select (select count(*) from messy) as row_count,
    (select cast(sum(n - 1) as bigint) from copies) as duplicate_row_count,
    (select count(*) from messy where {any_missing()}) as incomplete_row_count
),
issue_rows as (
  select 1 as kind, ordinal as ord, 'missing_' || name as id, 'missing_values' as type,
    case when missing_count / row_count >= 0.2 then 'high' when missing_count / row_count >= 0.05 then 'medium' else 'low' end as severity,
    name as "column", missing_count as count,
    format('{{:,}}', missing_count) || ' missing value' || case when missing_count = 1 then '' else 's' end || ' in `' || name || '`' as description
  from prof where missing_count > 0 and not is_empty
  union all
  select 2, 0, 'duplicate_rows', 'duplicate_rows',
    case when duplicate_row_count / row_count >= 0.1 then 'high' when duplicate_row_count / row_count >= 0.02 then 'medium' else 'low' end,
    null, duplicate_row_count,
    format('{{:,}}', duplicate_row_count) || ' duplicate row' || case when duplicate_row_count = 1 then '' else 's' end || ' detected'
  from totals where duplicate_row_count > 0
  union all
  select 3, ordinal, 'inconsistent_' || name, 'inconsistent_values', 'medium', name, inconsistent_spellings,
    '`' || name || '` contains ' || inconsistent_groups || ' group' || case when inconsistent_groups = 1 then '' else 's' end || ' of values that differ only in case or whitespace'
  from prof where inconsistent_groups > 0
  union all
  select 4, ordinal, 'outliers_' || name, 'potential_outliers', 'low', name, outlier_count,
    outlier_count || ' potential outlier' || case when outlier_count = 1 then '' else 's' end || ' detected in `' || name || '`'
  from prof where outlier_count > 0
  union all
  select 5, ordinal, 'empty_column_' || name, 'empty_column', 'medium', name, row_count,
    '`' || name || '` contains no values — the column is entirely empty'
  from prof where is_empty
),
issues as (select *, row_number() over (order by kind, ord) as ordinal from issue_rows),
score as (
  select cast(floor(greatest(0, least(100, 100 - (
      case when cells_filled > 0 then miss / cells_filled * 30 else 0 end
    + case when row_count > 0 then duplicate_row_count / row_count * 20 else 0 end
    + least(bad_cols, 4) * 5
    + case when num_cells > 0 then out_cells / num_cells * 10 else 0 end
    + least(empty_cols, 4) * 2.5))) + 0.5) as bigint) as quality_score, *
  from (select t.*, p.* from totals t, (
    select sum(case when is_empty then 0 else row_count end) as cells_filled,
      cast(sum(case when is_empty then 0 else missing_count end) as bigint) as miss,
      count(*) filter (where inconsistent_groups > 0) as bad_cols,
      sum(case when inferred_type = 'number' then total_values else 0 end) as num_cells,
      sum(outlier_count) as out_cells, count(*) filter (where is_empty) as empty_cols, count(*) as n_cols
    from prof) p)
),
flags as (
  select m.row_id, {any_missing()} as has_missing,
    row_number() over (partition by {row_key('m')} order by m.row_id) > 1 as is_duplicate,
    coalesce(m.priority is not null and not {missing('m.priority')} and exists (
      select 1 from forms f where f.col = 'priority' and f.normal_form = {norm('m.priority')}), false) as has_inconsistent,
    exists (select 1 from nums n join fence f on n.col = f.col
            where n.row_id = m.row_id and (n.x < f.lower or n.x > f.upper)) as has_outlier
  from messy m
)
"""


def q(select: str) -> str:
    return PRELUDE + select


def over(table_sql: str, select: str, name: str = "t") -> str:
    return f"with {name} as ({table_sql})\n{select}"


def messy(select: str) -> str:
    return over(MESSY, select, "messy")


# --- recipe: the steps as a chain of tables ---------------------------------------------------

RECIPE = f"""with messy as ({MESSY}),
s1 as (select * from messy qualify row_number() over (partition by {row_key()} order by row_id) = 1),
med as (select quantile_cont(x, 0.5) as v from (
  select {prefix_number('total')} as x from s1 where not {missing('total')})),
s2 as (select * replace (case when {missing('total')} then (select {number_text('v')} from med) else total end as total) from s1),
s3 as (select * replace (case when {missing('priority')} then priority else {title(trimmed('priority'))} end as priority) from s2),
s4 as (select * replace (case when {missing('order_date')} then order_date
         else coalesce(strftime({date_of('order_date')}, '%Y-%m-%d'), order_date) end as order_date) from s3),
s5 as (select * replace (case when {missing('filled')} then filled else coalesce({bool_word('filled')}, filled) end as filled) from s4),
lim as (select quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from (
  select {prefix_number('total')} as x from s5 where not {missing('total')})),
s6 as (select s5.* from s5, lim where not coalesce({prefix_number('total')} < q1 - 1.5 * (q3 - q1)
         or {prefix_number('total')} > q3 + 1.5 * (q3 - q1), false)),
s7 as (select * exclude (notes) from s6)
"""


def typed_profile(table: str, kinds: dict[str, str]) -> str:
    """Per column of a typed table, from its own values."""
    parts = []
    for i, (c, kind) in enumerate(kinds.items(), 1):
        number, date = kind == "number", kind == "date"
        q = lambda p: f"quantile_cont(cast({c} as double), {p})"
        far = f"(select count(*) from {table}, (select {q(0.25)} as q1, {q(0.75)} as q3 from {table}) where q1 <> q3 and ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)))"
        day = lambda f: f"strftime({f}({c}), '%Y-%m-%d')" if date else "cast(null as varchar)"
        figure = lambda x: f"round({x}, 4)" if number else "cast(null as double)"
        distinct = f"date_trunc('millisecond', {c})" if date else c
        parts.append(
            f"select cast({i} as bigint) as ordinal, '{c}' as name, '{kind}' as inferred_type, count({c}) as total_values, "
            f"count(*) - count({c}) as missing_count, count(distinct {distinct}) as unique_count, {figure(f'avg({c})')} as mean, "
            f"{figure(q(0.5))} as median, {figure(q(0.99))} as p99, {day('min')} as earliest, {day('max')} as latest, "
            f"{far if number else 'cast(0 as bigint)'} as outlier_count from {table}"
        )
    return " union all ".join(parts)


# Type, rank, chart, label, default aggregation, needs a y column.
RECOMMENDATIONS = """('number', 1, 'histogram', 'Histogram', 'count', false), ('number', 2, 'bar', 'Bar chart', 'mean', false),
('text', 1, 'donut', 'Donut chart', 'count', false), ('text', 2, 'bar', 'Bar chart', 'count', false),
('boolean', 1, 'donut', 'Donut chart', 'count', false), ('date', 1, 'line', 'Line chart', 'count', false),
('date', 2, 'bar', 'Bar chart', 'count', false), ('unknown', 1, 'bar', 'Bar chart', 'count', false)"""
SEVERITY_PLACE = (
    "row_number() over (order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, ordinal)"
)


def cleaning_summary(steps: list[tuple[str, str | None]]) -> str:
    """The report of the whole recipe: profiles of the first and last version, counts on each."""
    total, x = missing("total"), prefix_number("total")
    counts = [
        f"(select count(*) from messy) - (select count(*) from (select distinct {row_key()} from messy))",
        f"(select count(*) from s1 where {total})",
        f"""(select coalesce(sum(n), 0) from (select count(distinct {trimmed('priority')}) as n from s2
          where not {missing('priority')} group by {norm('priority')} having count(distinct {trimmed('priority')}) >= 2))""",
        f"(select count(*) from s3 where not {missing('order_date')})",
        f"(select count(*) from s4 where not {missing('filled')})",
        f"(select count(*) from s5, lim where not {total} and ({x} < q1 - 1.5 * (q3 - q1) or {x} > q3 + 1.5 * (q3 - q1)))",
        "0",
    ]
    listed = " union all ".join(
        f"""select cast({i} as bigint) as step, '{kind}' as type, {repr(column) if column else 'null'} as "column",
        cast({n} as bigint) as affected_count""" for i, ((kind, column), n) in enumerate(zip(steps, counts, strict=True), 1)
    )
    last = PRELUDE.replace(f"with messy as ({MESSY})", f"with messy as ({RECIPE} select * from s7)")
    last = last.replace(_CELLS, " union all ".join(x for x in _CELLS.split(" union all ") if "'notes'" not in x))
    for key in (row_key(), row_key("m"), any_missing()):
        last = last.replace(key, key.replace(", coalesce(notes, '')", "").replace(", coalesce(m.notes, '')", "").replace(f" or {missing('notes')}", ""))
    return f"""select 'messy_orders' as name, b.row_count as rows_before, a.row_count as rows_after, b.n_cols as columns,
      b.quality_score as score_before, a.quality_score as score_after, c.*
    from ({PRELUDE} select * from score) b, ({last} select * from score) a, ({RECIPE} select * from ({listed})) c"""


def top_groups(groups: str) -> str:
    """Top 29 and Other of a (label, value, first_row) query."""
    return f"""with g as ({groups}),
r as (select *, row_number() over (order by value desc, first_row, label) as position, count(*) over () as n from g),
kept as (
  select cast(position as bigint) as position, label, value from r where n <= 30 or position <= 29
  union all
  select 30, 'Other', {half_up('sum(value)', 2)} from r where n > 30 and position > 29 having count(*) > 0
)
"""


def messy_groups(fn: str) -> str:
    y = whole_number("total")
    value = {"count": f"count({y})", "sum": f"sum({y})", "mean": f"avg({y})", "min": f"min({y})", "max": f"max({y})"}[fn]
    return (
        f"select {trimmed('priority')} as label, round(coalesce(cast({value} as double), 0), 2) as value, "
        f"min(row_id) as first_row from messy where not {missing('priority')} group by 1"
    )


def event_groups(value: str) -> str:
    return (
        f"select cast(user_id as varchar) as label, coalesce(cast({value} as double), 0) as value, "
        "min(event_id) as first_row from events where user_id is not null group by 1"
    )


# --- suggestions ---------------------------------------------------------------------------------

_JSON = f"""case when json_valid({trimmed('reply')}) then {trimmed('reply')}
  when json_valid(nullif({trimmed("regexp_extract(" + trimmed('reply') + ", '(?is)^```(?:json)?\\s*(.*?)```\\s*$', 1)")}, ''))
    then {trimmed("regexp_extract(" + trimmed('reply') + ", '(?is)^```(?:json)?\\s*(.*?)```\\s*$', 1)")}
  when json_valid(nullif(regexp_extract(reply, '(?s)[{{].*[}}]'), '')) then regexp_extract(reply, '(?s)[{{].*[}}]') end"""


def _field(name: str) -> str:
    return f"case when json_type(item, '$.{name}') = 'VARCHAR' then json_extract_string(item, '$.{name}') end"


SUGGESTIONS = f"""replies as ({REPLIES}),
parsed as (select dataset, reply_id, {_JSON} as j from replies),
items as (
  select dataset, reply_id, unnest(cast(json_extract(j, '$.suggestions') as json[])) as item,
    generate_subscripts(cast(json_extract(j, '$.suggestions') as json[]), 1) - 1 as pos
  from parsed where j is not null
),
sug as (
  select dataset, reply_id, 'ai_' || pos as id, {_field('column')} as "column", {_field('issueType')} as issue_type,
    left({_field('title')}, 80) as title, left({_field('reason')}, 200) as reason,
    case when {_field('operationType')} in ('remove_duplicates','fill_missing','normalize_text','convert_type','remove_outlier_rows')
      then {_field('operationType')} end as operation,
    {_field('strategy')} as strategy,
    case when json_type(item, '$.confidence') in ('DOUBLE','UBIGINT','BIGINT','INTEGER')
      then greatest(0.0, least(1.0, cast(json_extract(item, '$.confidence') as double))) else 0.8 end as confidence
  from items
),
kept as (select * from sug where title is not null and reason is not null)
"""

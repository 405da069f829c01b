"""The same queries as SQL over the star-schema views, for comparison in DuckDB."""

from __future__ import annotations

from packhouse.plans.parameters import DIGITS, FRAUD_PARAMETERS, LATER_TS, RUN_TS, SEARCH_TEXTS
from packhouse.schemas import FRAUD_FEATURES, LATE_FEATURES, TABLES

TIME = "'%Y-%m-%d %H:%M:%S.%f'"


def _score(total: str = "order_total", time: str = "order_datetime") -> str:
    text = f"strftime({time}, '%Y-%m-%d %H:%M:%S')"
    return (
        "least(0.99, greatest(0.01, ((order_id * 374761 + customer_id * 66041"
        f" + cast(floor({total} * 100 + 0.5) as bigint) * 104729"
        f" + cast(list_sum(list_transform(range(1, 20), lambda i: ascii(substr({text}, cast(i as int), 1)) * i)) as bigint))"
        " % 4294967296 % 10000) / cast(10000 as double)))")


MAPPED = f"""
with customers as (
  select c_custkey + 1 as customer_id, c_name as full_name,
    lower(replace(c_name, '#', '.')) || '@example.edu' as email,
    case when c_custkey % 50 = 0 then null when c_custkey % 97 = 0 then 'unknown'
      else (1950 + c_custkey % 50)::varchar || '-' || lpad((1 + c_custkey % 12)::varchar, 2, '0') || '-'
        || lpad((1 + c_custkey % 28)::varchar, 2, '0') end as birthdate
  from customer),
products as (
  select p_partkey + 1 as product_id, p_name as product_name, p_retailprice as price,
    p_retailprice * ((30 + (p_partkey % 5) * 10) / cast(100 as double)) as cost
  from part),
shop_orders as (
  select o_orderkey + 1 as order_id, o_custkey + 1 as customer_id,
    o_orderdate + to_seconds((o_orderkey * 7919) % 86400) as order_datetime,
    o_totalprice as order_total, cast((o_orderkey * 31 + 17) % 101 as double) as risk_score,
    case when (o_orderkey * 31 + 17) % 101 + (o_orderkey * 7919 + 13) % 61 >= 130 then 1 else 0 end as is_fraud
  from orders),
items as (
  select l_orderkey + 1 as order_id, l_partkey + 1 as product_id, cast(l_quantity as bigint) as quantity,
    l_extendedprice / l_quantity as unit_price, l_extendedprice as line_total
  from lineitem),
numbered as (
  select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_shipdate, l_linestatus) as line_id
  from lineitem),
order_items as (
  select line_id as order_item_id, l_orderkey + 1 as order_id, l_partkey + 1 as product_id,
    cast(l_quantity as bigint) as quantity, l_extendedprice / l_quantity as unit_price,
    l_extendedprice as line_total
  from numbered),
shipped as (select l_orderkey + 1 as order_id from lineitem where l_linestatus = 'F'),
shipments as (
  select line_id as shipment_id, l_orderkey + 1 as order_id,
    case when l_shipdate > o_orderdate + interval 700 days then 1 else 0 end as late_delivery
  from numbered join orders on o_orderkey = l_orderkey where l_linestatus = 'F'),
order_predictions as (
  select order_id, ((order_id * 13) % 1000) / cast(1000 as double) as late_delivery_probability,
    case when (order_id * 13) % 1000 >= 500 then 1 else 0 end as predicted_late_delivery,
    {_score()} as fraud_probability, case when {_score()} >= 0.5 then 1 else 0 end as predicted_fraud,
    timestamp '2002-01-01 00:00:00' as prediction_timestamp
  from shop_orders where order_id % 3 <> 0),
order_requests as (
  select event_id + 1 as request_id, ts as requested_at,
    case when event_id % 23 = 0 then 'abc' when event_id % 29 = 0 then '0'
      when event_id % 31 = 0 then '99999999' else (user_id + 1)::varchar end as customer_ref,
    case when event_id % 13 = 0 then '[]' when event_id % 17 = 0 then 'not json'
      when event_id % 19 = 0 then '[{{"product_id":' || (event_id % 200 + 1) || ',"quantity":0}}]'
      when event_id % 37 = 0 then '[{{"product_id":99999999,"quantity":1}}]'
      when event_id % 41 = 0 then '[{{"product_id":1,"quantity":1}},5]'
      when event_id % 7 = 0 then '[{{"product_id":"' || (event_id % 200 + 1) || '","quantity":"2abc"}}]'
      else '[{{"product_id":' || (event_id % 200 + 1) || ',"quantity":' || (event_id % 5 + 1)
        || '}},{{"product_id":' || ((event_id * 3) % 200 + 1) || ',"quantity":1.9}}]' end as order_lines
  from events where event_type = 'purchase'),
open_orders as (
  select o.* from shop_orders o where not exists (select 1 from shipped s where s.order_id = o.order_id)),
order_claims as (
  select o_orderkey as claim_id,
    case when o_orderkey % 7 = 0 then 'x' || o_orderkey when o_orderkey % 11 = 0 then ' ' || (o_orderkey + 1) || 'abc'
      else (o_orderkey + 1)::varchar end as order_ref,
    case when o_orderkey % 5 = 0 then o_custkey + 2 else o_custkey + 1 end as customer_id
  from orders),
claimed as (
  select *, try_cast(nullif(regexp_extract(order_ref, '^\\s*([+-]?[0-9]+)', 1), '') as bigint) as order_id
  from order_claims),
item_counts as (select order_id, count(*) as item_count from items group by order_id),
shipment_counts as (select order_id, count(*) as shipment_count from shipped group by order_id),
counted as (
  select o.*, coalesce(item_count, 0) as item_count, coalesce(shipment_count, 0) as shipment_count,
    case when coalesce(shipment_count, 0) > 0 then 'Shipped' else 'Open' end as status,
    row_number() over (partition by customer_id order by order_datetime desc nulls last, o.order_id) as rank
  from shop_orders o left join item_counts i on i.order_id = o.order_id
    left join shipment_counts s on s.order_id = o.order_id),
spend as (
  select customer_id, count(*) as order_count, sum(order_total) as total_spend,
    max(order_datetime) as last_order_datetime
  from shop_orders group by customer_id),
serving_items as (
  select order_id, cast(sum(quantity) as bigint) as num_items, sum(line_total) as total_value, avg(cost) as avg_cost
  from items join products using (product_id) group by order_id),
training_items as (
  select order_id, cast(coalesce(sum(quantity), 0) as bigint) as num_items, avg(unit_price) as avg_unit_price,
    coalesce(sum(line_total), 0) as total_value, avg(cost) as avg_cost
  from items left join products using (product_id) group by order_id),
customer_counts as (select customer_id, count(*) as customer_order_count from shop_orders group by customer_id),
aged as (
  select o.*, c.birthdate, c.full_name, c.customer_id as known_customer,
    cast(floor(floor((epoch_us(order_datetime) - epoch_us(try_cast(birthdate as timestamp))) / 86400000000.0)
      / 365.0) as double) as customer_age
  from shop_orders o left join customers c on c.customer_id = o.customer_id),
serving as (
  select a.order_id, risk_score, cast(coalesce(num_items, 0) as double) as num_items,
    coalesce(total_value, order_total) as total_value, coalesce(avg_cost, order_total) as avg_cost,
    customer_age, cast(coalesce(customer_order_count, 1) as double) as customer_order_count
  from aged a left join serving_items i on i.order_id = a.order_id
    left join customer_counts n on n.customer_id = a.customer_id
  where known_customer is not null
    and not exists (select 1 from shipped s where s.order_id = a.order_id)),
training as (
  select a.order_id, risk_score, cast(num_items as double) as num_items, total_value, avg_cost, customer_age,
    cast(customer_order_count as double) as customer_order_count, is_fraud
  from aged a left join training_items i on i.order_id = a.order_id
    left join customer_counts n on n.customer_id = a.customer_id),
parsed as (
  select request_id, case when json_valid(order_lines) and json_type(order_lines) = 'ARRAY'
    then order_lines end as payload
  from order_requests),
raw_lines as (
  select request_id, i + 1 as line_no,
    json_extract_string(payload, '$[' || i || '].product_id') as product_text,
    json_extract_string(payload, '$[' || i || '].quantity') as quantity_text
  from (select request_id, payload, unnest(range(cast(json_array_length(payload) as bigint))) as i
        from parsed where payload is not null)),
lines as (
  select request_id, line_no,
    try_cast(nullif(regexp_extract(product_text, '^\\s*([+-]?[0-9]+)', 1), '') as bigint) as product_id,
    try_cast(nullif(regexp_extract(quantity_text, '^\\s*([+-]?[0-9]+)', 1), '') as bigint) as quantity
  from raw_lines),
line_state as (
  select request_id, bool_and(coalesce(product_id > 0 and quantity > 0, false)) as ok,
    bool_or(coalesce(product_id > 0 and quantity > 0, false)) as any_ok,
    count(*) as n_lines, bool_and(price is not null) as known,
    sum(case when quantity > 0 then quantity * price end) as total
  from lines left join products using (product_id) group by request_id),
resolved as (
  select r.*, c.customer_id,
    try_cast(nullif(regexp_extract(customer_ref, '^\\s*([+-]?[0-9]+)', 1), '') as bigint) as asked
  from order_requests r left join customers c on c.customer_id =
    try_cast(nullif(regexp_extract(customer_ref, '^\\s*([+-]?[0-9]+)', 1), '') as bigint)),
decided as (
  select r.request_id, r.requested_at, r.customer_id, s.n_lines, s.total,
    case when r.customer_id is null then 'no_customer' when not coalesce(s.ok, false) then 'lines'
      when not s.known then 'product' else 'accepted' end as status
  from resolved r left join line_state s using (request_id)),
new_orders as (
  select *, (select max(order_id) from shop_orders) + row_number() over (order by requested_at, request_id) as order_id
  from decided where status = 'accepted'),
new_items as (
  select n.order_id, request_id, customer_id, requested_at, total, product_id, quantity, price,
    (select max(order_item_id) from order_items) + row_number() over (order by n.order_id, line_no) as order_item_id
  from new_orders n join lines using (request_id) join products using (product_id)),
hash_predictions as (
  select order_id, 0.0::double as late_delivery_probability, 0 as predicted_late_delivery,
    {_score()} as fraud_probability, case when {_score()} >= 0.5 then 1 else 0 end as predicted_fraud
  from open_orders),
labeled as (
  select order_id as id, is_fraud as label, {_score()} as prob, case when {_score()} > 0.5 then 1 else 0 end as pred
  from shop_orders),
confusion as (
  select count(*) filter (label = 1 and pred = 1) as tp, count(*) filter (label <> 1 and pred = 1) as fp,
    count(*) filter (label = 1 and pred <> 1) as fn, count(*) filter (label <> 1 and pred <> 1) as tn, count(*) as n
  from labeled)
"""


def _round(expression: str) -> str:
    return f"round({expression} @shown)"


def _r(*columns: str) -> str:
    return ", ".join(f"{_round(c)} as {c.split('.')[-1]}" for c in columns)


def _t(column: str, name: str | None = None) -> str:
    return f"strftime({column}, {TIME}) as {name or column.split('.')[-1]}"


_ORDER = f"customer_id, order_id, {_t('order_datetime')}, {_r('order_total')}, item_count, shipment_count, status"
_SCORES = "late_delivery_probability, predicted_late_delivery, fraud_probability, predicted_fraud"
_START = (
    "((order_id % 2147483648) * 2654435761 + ((order_id // 2147483648) % 2147483648 * 69069) % 4294967296"
    " + 42 * 2654435769 % 4294967296) % 4294967296")
_PLACED = f"""select order_id, request_id, customer_id, {_t('requested_at', 'order_datetime')},
  round(total @shown) as order_total, 50.0::double as risk_score, order_item_id, product_id,
  cast(quantity as bigint) as quantity, round(price @shown) as unit_price, round(quantity * price @shown) as line_total
  from new_items"""
_MEDIANS = ", ".join(f"quantile_cont({c}, 0.5) as {c}" for c in FRAUD_FEATURES)
_FILLED = ", ".join(f"coalesce(t.{c}, m.{c}) as {c}" for c in FRAUD_FEATURES)
_FILLED_CTE = f"filled as (select t.order_id, {_FILLED}, is_fraud from training t, (select {_MEDIANS} from training) m)"


def _scaled() -> str:
    z = ", ".join(
        f"round((f.{c} - s.m_{c}) / case when s.s_{c} = 0 then 1 else s.s_{c} end @shown) as {c}"
        for c in FRAUD_FEATURES)
    stats = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in FRAUD_FEATURES)
    return f", {_FILLED_CTE} select order_id, {z}, is_fraud from filled f, (select {stats} from filled) s"


def _summary() -> str:
    return " union all ".join(
        f"""select '{c}' as feature, count({c}) as count, {_r2(f'avg({c})', 'mean')},
        {_r2(f'stddev_samp({c})', 'std')}, {_r2(f'min({c})', 'min')}, {_r2(f'quantile_cont({c}, 0.25)', 'p25')},
        {_r2(f'quantile_cont({c}, 0.5)', 'p50')}, {_r2(f'quantile_cont({c}, 0.75)', 'p75')},
        {_r2(f'max({c})', 'max')} from training""" for c in FRAUD_FEATURES)


def _r2(expression: str, name: str) -> str:
    return f"{_round(expression)} as {name}"


def _model_score() -> str:
    p = FRAUD_PARAMETERS
    margin = " + ".join(
        [repr(p.intercept)] + [
            f"({w!r}) * ((coalesce({c}, {m!r}) - ({a!r})) / {d!r})" for c, m, a, d, w in
            zip(p.features, p.medians, p.means, p.deviations, p.coefficients)])
    return f"""select order_id, 0.0::double as late_delivery_probability, 0 as predicted_late_delivery,
      round(p @shown) as fraud_probability, case when p >= 0.5 then 1 else 0 end as predicted_fraud
      from (select order_id, 1 / (1 + exp(-cast({margin} as double))) as p from serving)"""


def _audit() -> str:
    def row(table: str, name: str, kind: str, count: str) -> str:
        return (f"select '{table}' as table_name, '{name}' as constraint_name, '{kind}' as kind,"
                f" cast(coalesce(({count}), 0) as bigint) as violations")

    parts = []
    for name, spec in TABLES.items():
        parts.append(row(name, "table_present", "presence", "0"))
        parts += [row(name, f"{c}_not_null", "not_null", f"select count(*) from {name} where {c} is null")
                  for c in spec.not_null()]
        parts += [row(name, n, "check", f"select count(*) from {name} where not ({c})") for n, c in spec.checks]
        key = spec.primary_key
        parts.append(row(name, f"{key}_unique", "primary_key",
                         f"select count({key}) - count(distinct {key}) from {name}"))
        parts += [row(name, f"{c}_in_{target}", "foreign_key",
                      f"select count(*) from {name} t where {c} is not null and not exists"
                      f" (select 1 from {target} x where x.{TABLES[target].primary_key} = t.{c})")
                  for c, target in spec.foreign_keys]
    return " union all ".join(parts)


def _profile() -> str:
    """Types come from the catalog, by Spark's names."""
    names = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "INTEGER": "int", "TIMESTAMP": "timestamp_ntz"}
    cases = " ".join(f"when '{a}' then '{b}'" for a, b in names.items())
    rows = []
    for name, spec in TABLES.items():
        for i, (c, _) in enumerate(spec.columns):
            default = spec.defaults.get(c)
            rows.append(
                f"select '{name}' as table_name, {i} as cid, '{c}' as name, case any_value(typeof({c})) {cases} end as type,"
                f" {int(c not in spec.nullable)} as notnull, {repr(default) if default else 'null::varchar'} as dflt_value,"
                f" {int(c == spec.primary_key)} as pk, count(*) as n_rows, count(*) - count({c}) as n_nulls from {name}")
    return " union all ".join(rows)


NEWTON_STEPS = 14


def _fitted(source: str, features: list[str], label: str, key: str) -> str:
    """CTEs that split `source`, fit the weighted, penalised regression by Newton steps, and score the test rows.

    `fitted_rows` has key, label, prob and pred. Each step is one row of sums over the training rows, solved by elimination
    written out as expressions; the parameters are the features' in order and the intercept.
    """
    ctes, marks = BODIES["stratified_split"].rsplit("select order_id, o.is_fraud", 1)
    marks = f"{ctes.rstrip()}, marks as (select order_id, o.is_fraud{marks})"
    marks = marks.replace("shop_orders", source).replace("is_fraud", label).replace("order_id", key)
    n = len(features) + 1
    z = [f"z{i}" for i in range(n - 1)] + ["1.0"]
    filled = ", ".join(f"coalesce(t.{c}, m.{c}) as {c}" for c in features)
    middles = ", ".join(f"quantile_cont({c}, 0.5) as {c}" for c in features)
    stats = ", ".join(f"avg({c}) as m{i}, stddev_pop({c}) as s{i}" for i, c in enumerate(features))
    scaled = ", ".join(f"(f.{c} - s.m{i}) / case when s.s{i} = 0 then 1 else s.s{i} end as z{i}" for i, c in enumerate(features))
    margin = " + ".join(f"b{i} * {z[i]}" for i in range(n))
    parts = [f"""{marks},
  sides as materialized (select t.*, is_test from {source} t join marks using ({key}) where t.{label} is not null),
  full_rows as (select t.{key}, t.{label} as y, is_test, {filled} from sides t, (select {middles} from sides where is_test = 0) m),
  z_rows as materialized (select f.{key}, y, is_test, {scaled}
    from full_rows f, (select {stats} from full_rows where is_test = 0) s),
  class_weights as (select y, (select count(*) from z_rows where is_test = 0) / cast(
    (select count(distinct y) from z_rows where is_test = 0) * count(*) as double) as w from z_rows where is_test = 0 group by y),
  train_rows as materialized (select r.*, w from z_rows r join class_weights using (y) where is_test = 0),
  beta0 as materialized (select {", ".join(f"0.0::double as b{i}" for i in range(n))})"""]
    for step in range(NEWTON_STEPS):
        sums = [f"sum(w * (p - y) * {z[i]}) + {f'any_value(b{i})' if i < n - 1 else '0'} as a{i}_{n}" for i in range(n)]
        sums += [f"sum(w * p * (1 - p) * {z[i]} * {z[j]}) + {int(i == j and i < n - 1)} as a{i}_{j}"
                 for i in range(n) for j in range(n)]
        parts.append(f"""e{step}_0 as materialized (select {", ".join(sums)}, {", ".join(f"any_value(b{i}) as b{i}" for i in range(n))}
    from (select *, 1 / (1 + exp(-({margin}))) as p from train_rows, beta{step}))""")
        for k in range(n):
            row = [f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} as a{i}_{j}" if i != k else f"a{k}_{j} / a{k}_{k} as a{k}_{j}"
                   for i in range(n) for j in range(k + 1, n + 1)]
            parts.append(f"""e{step}_{k + 1} as materialized (select {", ".join(row)}, {", ".join(f"b{i}" for i in range(n))}
    from e{step}_{k})""")
        parts.append(f"""beta{step + 1} as materialized (select {", ".join(f"b{i} - a{i}_{n} as b{i}" for i in range(n))} from e{step}_{n})""")
    parts.append(f"""fitted_rows as materialized (select {key}, y as label, p as prob, cast(p > 0.5 as int) as pred
    from (select *, 1 / (1 + exp(-({margin}))) as p from z_rows, beta{NEWTON_STEPS} where is_test = 1)),
  fitted_confusion as (
    select count(*) filter (label = 1 and pred = 1) as tp, count(*) filter (label <> 1 and pred = 1) as fp,
      count(*) filter (label = 1 and pred <> 1) as fn, count(*) filter (label <> 1 and pred <> 1) as tn, count(*) as n
    from fitted_rows)""")
    return ", ".join(parts)


def _of_fitted(body: str) -> str:
    return BODIES[body].replace("from labeled", "from fitted_rows").replace("from confusion", "from fitted_confusion")


def _model_bodies() -> dict[str, str]:
    fraud = _fitted("training", FRAUD_FEATURES, "is_fraud", "order_id")
    late = f", late as materialized ({BODIES['late_delivery_features']})".replace("@shown)", ", 9)").replace("round(order_total , 9)", "order_total")
    late += _fitted("late", LATE_FEATURES, "late_delivery", "shipment_id")
    return {
        "fit_logistic": fraud + _of_fitted("binary_metrics"),
        "model_card": f"""{fraud} select 'fraud_detection_pipeline' as model_name, '1.0.0' as model_version, '{RUN_TS}' as trained_at_utc,
          'mapped orders' as training_data, (select count(*) from z_rows where is_test = 0) as num_training_rows,
          (select count(*) from z_rows where is_test = 1) as num_test_rows, '{",".join(FRAUD_FEATURES)}' as features,
          'is_fraud' as label""",
        "model_smoke_check": f"""{fraud} select order_id, round(round(prob, 4) @shown) as prob
          from fitted_rows order by order_id limit 3""",
        "late_delivery_evaluate": late + _of_fitted("classification_report"),
    }


_LOGS = """
, run_logs as (
  select doc_id + 1 as run_id, case when doc_id % 5 = 0 then 1 else 0 end as exit_code,
    text || case doc_id % 6
      when 0 then chr(10) || 'RESULT orders_scored=' || (doc_id % 1000) || chr(10) || 'RESULT fraud_flagged_ids='
        || (doc_id + 1) || ',' || (doc_id + 2) || chr(10)
      when 1 then chr(10) || 'Orders Scored : ' || (doc_id % 1000)
      when 2 then chr(10) || 'scored ' || (doc_id % 1000) || ' orders'
      when 3 then chr(10) || 'RESULT  orders_scored=' || (doc_id % 1000) || chr(10) || 'RESULT fraud_flagged_ids='
      else '' end as stdout,
    case when doc_id % 6 = 4 then 'orders-scored = ' || (doc_id % 1000) else '' end as stderr
  from documents),
texts as (select *, stdout || chr(10) || stderr as t from run_logs)
select run_id, cast(exit_code = 0 as int) as ok,
  coalesce(
    try_cast(nullif(regexp_extract(t, '(?i)orders[_\\s-]?scored\\s*[:=]\\s*([0-9]+)', 1), '') as bigint),
    try_cast(nullif(regexp_extract(t, '(?i)RESULT\\s+orders_scored=([0-9]+)', 1), '') as bigint),
    try_cast(nullif(regexp_extract(t, '(?i)scored\\s+([0-9]+)\\s+orders', 1), '') as bigint)) as orders_scored,
  regexp_extract(stdout, 'RESULT fraud_flagged_ids=([0-9,]*)', 1) as flagged_ids,
  case when length(stdout) > 4000 then substr(stdout, 1, 4000) || chr(10) || '… (truncated)' else stdout end
    as stdout_preview,
  stderr as stderr_preview,
  case when exit_code <> 0 then 'Python process exited with code ' || exit_code end as error_message
from texts"""

_NEEDLES = " union ".join(f"select '{n}' as needle" for n in SEARCH_TEXTS)
_HAY = "lower(full_name || ' ' || email || ' ' || customer_id)"

BODIES: dict[str, str] = {
    "customers_list": "select customer_id, full_name, email from customers",
    "products_list": "select product_id, product_name, price from products",
    "customer_search": f"select needle, customer_id, full_name, email from customers, ({_NEEDLES})"
                       f" where contains({_HAY}, lower(trim(needle)))",
    "customer_search_table": f"select needle, customer_id, full_name, email from customers,"
                             f" (select distinct ' ' || regexp_extract(s_name, '#(.*)$', 1) as needle from supplier)"
                             f" where contains({_HAY}, lower(trim(needle)))",
    "customer_resolve": """select request_id, customer_ref, case when asked > 0 then asked end as customer_id,
        case when coalesce(asked, 0) <= 0 then 'invalid' when customer_id is null then 'unknown' else 'ok' end as status
        from resolved""",
    "customer_resolve_session": """select request_id, customer_ref, case when asked > 0 then asked end as customer_id,
        case when coalesce(asked, 0) <= 0 then 'none' when customer_id is null then 'invalid_cookie' else 'ok' end
        as status from resolved""",
    "product_price": """select product_id, round(price @shown) as price from products
        where product_id in (select l_partkey * 2 + 1 from lineitem)""",
    "open_orders": f"""select order_id, customer_id, {_t('order_datetime')}, {_r('order_total', 'risk_score')}
        from open_orders""",
    "open_orders_for_scoring": f"""select order_id, customer_id, {_t('order_datetime', 'order_timestamp')},
        round(order_total @shown) as total_value from open_orders""",
    "order_ownership": """select claim_id, order_ref, c.customer_id, c.order_id,
        cast(coalesce(o.customer_id = c.customer_id, false) as int) as belongs
        from claimed c left join shop_orders o on o.order_id = c.order_id""",
    "order_header": f"""select claim_id, order_ref, c.customer_id, c.order_id, {_t('o.order_datetime')},
        {_r('o.order_total')}, item_count from claimed c
        join counted o on o.order_id = c.order_id and o.customer_id = c.customer_id""",
    "fulfillment_status": "select order_id, status from counted",
    "customer_order_stats": f"""select c.customer_id, coalesce(order_count, 0) as order_count,
        round(coalesce(total_spend, 0) @shown) as total_spend, {_t('last_order_datetime')}
        from customers c left join spend s on s.customer_id = c.customer_id""",
    "order_counts": "select order_id, item_count, shipment_count from counted",
    "customer_order_counts": "select customer_id, customer_order_count from customer_counts",
    "warehouse_priority_queue": f"""select o.order_id, {_t('order_datetime')}, {_r('order_total')}, c.customer_id,
        trim(coalesce(full_name, '')) as customer_name, case when p.order_id is not null then 1 else 0 end as has_prediction,
        coalesce(late_delivery_probability, 0) as late_delivery_probability,
        coalesce(predicted_late_delivery, 0) as predicted_late_delivery,
        coalesce(fraud_probability, 0) as fraud_probability, coalesce(predicted_fraud, 0) as predicted_fraud,
        coalesce(strftime(prediction_timestamp, '%Y-%m-%d %H:%M:%S'), '') as prediction_timestamp
        from open_orders o join customers c on c.customer_id = o.customer_id
        left join order_predictions p on p.order_id = o.order_id
        order by has_prediction desc, coalesce(p.fraud_probability, 0) desc,
          coalesce(p.late_delivery_probability, 0) desc, o.order_datetime asc nulls last, o.order_id limit 50""",
    "fraud_flagged_open_orders": f"""select o.order_id, {_r('order_total')}, trim(coalesce(full_name, '')) as customer_name,
        fraud_probability from open_orders o join customers c on c.customer_id = o.customer_id
        join order_predictions p on p.order_id = o.order_id where predicted_fraud = 1""",
    "customer_recent_orders": f"select {_ORDER} from counted where rank <= 5",
    "customer_orders": f"select {_ORDER} from counted",
    "order_line_items": f"""select order_id, order_item_id, product_name, quantity, {_r('unit_price', 'line_total')}
        from order_items join products using (product_id)""",
    "customer_overview": f"""select c.customer_id, full_name, email, coalesce(order_count, 0) as order_count,
        round(coalesce(total_spend, 0) @shown) as total_spend, {_t('last_order_datetime')},
        coalesce(recent_orders, '') as recent_orders
        from customers c left join spend s on s.customer_id = c.customer_id
        left join (select customer_id, string_agg(order_id || ':' || strftime(order_datetime, '%Y-%m-%d %H:%M:%S')
            || ':' || item_count || ':' || shipment_count || ':' || status, ',' order by rank) as recent_orders
          from counted where rank <= 5 group by customer_id) r on r.customer_id = c.customer_id""",
    "item_aggregates_serving": f"select order_id, num_items, {_r('total_value', 'avg_cost')} from serving_items",
    "item_aggregates_training": f"""select order_id, num_items, {_r('avg_unit_price', 'total_value', 'avg_cost')}
        from training_items""",
    "label_distribution": """select is_fraud as label,
        round(count(*) / cast((select count(*) from shop_orders) as double) @shown) as share
        from shop_orders group by is_fraud""",
    "feature_summary": _summary(),
    "fraud_features_serving": f"select order_id, {_r(*FRAUD_FEATURES)} from serving",
    "fraud_features_training": f"select order_id, {_r(*FRAUD_FEATURES)}, is_fraud from training",
    "late_delivery_features": f"""select shipment_id, s.order_id, {_r('order_total')}, coalesce(num_items, 0) as num_items,
        cast(hour(order_datetime) as int) as hour_of_day, cast(isodow(order_datetime) - 1 as int) as day_of_week,
        late_delivery from shipments s join shop_orders o on o.order_id = s.order_id
        left join (select order_id, cast(sum(quantity) as bigint) as num_items from items group by order_id) i
          on i.order_id = s.order_id""",
    "customer_age": "select order_id, customer_age from aged",
    "stratified_split": f""", sizes as (
          select is_fraud, n_class, n, n - ceil(n * 0.25) as n_train from (
            select is_fraud, count(*) as n_class, (select count(*) from shop_orders) as n
            from shop_orders group by is_fraud)),
        shares as (select *, n_class * n_train / cast(n as double) as exact from sizes),
        allotted as (
          select is_fraud, n_class - (floor(exact) + case when
              row_number() over (order by exact - floor(exact) desc, is_fraud)
              <= n_train - sum(floor(exact)) over () then 1 else 0 end) as n_test from shares),
        started as (select order_id, is_fraud, {_START} as h from shop_orders),
        mixed as (select order_id, is_fraud, xor(h, h >> 15) * 1274126177 % 4294967296 as m from started)
        select order_id, o.is_fraud, cast(row_number() over (partition by o.is_fraud
          order by xor(m, m >> 13), order_id) <= n_test as int) as is_test
        from mixed o join allotted a on a.is_fraud = o.is_fraud""",
    "median_impute": f""", {_FILLED_CTE} select order_id, {_r(*FRAUD_FEATURES)}, is_fraud from filled""",
    "standard_scale": _scaled(),
    "balanced_weights": """select order_id, is_fraud, round((select count(*) from shop_orders)
        / cast(2 * count(*) over (partition by is_fraud) as double) @shown) as weight from shop_orders""",
    "binary_metrics": """, ranked as (
          select label, avg(position) over (partition by prob) as r
          from (select label, prob, row_number() over (order by prob) as position from labeled)),
        area as (
          select (sum(r) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0)
            / (cast(count(*) filter (label = 1) as double) * count(*) filter (label <> 1)) as roc_auc from ranked)
        select round((tp + tn) / cast(n as double) @shown) as accuracy,
          round(2 * tp / cast(2 * tp + fp + fn as double) @shown) as f1, round(roc_auc @shown) as roc_auc
        from confusion, area""",
    "classification_report": """, classes as (
          select '0' as class, tn / cast(tn + fn as double) as precision, tn / cast(tn + fp as double) as recall,
            2 * tn / cast(2 * tn + fn + fp as double) as f1, tn + fp as support from confusion
          union all
          select '1', tp / cast(tp + fp as double), tp / cast(tp + fn as double),
            2 * tp / cast(2 * tp + fp + fn as double), tp + fn from confusion),
        report as (
          select * from classes
          union all select 'accuracy', a, a, a, n from (select (tp + tn) / cast(n as double) as a, n from confusion)
          union all select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from classes
          union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
            sum(f1 * support) / sum(support), cast(sum(support) as bigint) from classes)
        select class, round(precision @shown) as precision, round(recall @shown) as recall, round(f1 @shown) as f1, support
        from report""",
    "hash_score": f"select order_id, {_score()} as score from shop_orders",
    "score_open_orders_hash": f"select order_id, {_SCORES} from hash_predictions",
    "score_open_orders_model": _model_score(),
    "upsert_predictions": f"""select order_id, late_delivery_probability, predicted_late_delivery, {_r('fraud_probability')},
        predicted_fraud, prediction_timestamp from (
          select order_id, late_delivery_probability, predicted_late_delivery,
            case when order_id % 3 = 0 then fraud_probability / 2 else fraud_probability end as fraud_probability,
            case when order_id % 3 = 0 then 0 else predicted_fraud end as predicted_fraud,
            strftime(timestamp '{RUN_TS}', {TIME}) as prediction_timestamp from hash_predictions
          union all by name
          select order_id, late_delivery_probability, predicted_late_delivery, fraud_probability, predicted_fraud,
            strftime(prediction_timestamp, {TIME}) as prediction_timestamp from order_predictions
          where order_id not in (select order_id from hash_predictions))""",
    "daily_scoring": f"""select order_id, {_SCORES}, strftime(ts, {TIME}) as prediction_timestamp from (
          select *, timestamp '{RUN_TS}' as ts from hash_predictions
          union all by name
          select order_id, {_SCORES}, prediction_timestamp as ts from order_predictions
          where order_id not in (select order_id from hash_predictions))""",
    "scoring_run": f"""select o.order_id, {_r('order_total')}, trim(coalesce(full_name, '')) as customer_name,
        fraud_probability from open_orders o join customers c on c.customer_id = o.customer_id
        join hash_predictions p on p.order_id = o.order_id where predicted_fraud = 1""",
    "scoring_run_summary": f"""select 1 as ok, 'mock' as provider, '{RUN_TS}' as timestamp,
        (select count(*) from hash_predictions) as orders_scored,
        (select count(*) from hash_predictions p join open_orders o on o.order_id = p.order_id
          join customers c on c.customer_id = o.customer_id where predicted_fraud = 1) as flagged_orders,
        null::varchar as error_message""",
    "customer_order_stats_maintained": f"""select c.customer_id, count(order_id) as order_count,
        round(coalesce(sum(order_total), 0) @shown) as total_spend, {_t('max(order_datetime)', 'last_order_datetime')}
        from customers c left join shop_orders o on o.customer_id = c.customer_id and order_id % 11 <> 5
        group by c.customer_id""",
    "customer_order_counts_maintained": """select customer_id, count(*) as customer_order_count
        from shop_orders where order_id % 11 <> 5 group by customer_id""",
    "order_counts_maintained": """select order_id, coalesce(i.n, 0) as item_count, coalesce(s.n, 0) as shipment_count from shop_orders
        left join (select order_id, count(*) as n from items where product_id % 9 <> 0 group by order_id) i using (order_id)
        left join (select order_id, count(*) as n from shipped group by order_id) s using (order_id)""",
    "scoring_by_change": f""", is_open as (select order_id from open_orders),
        before as (
          select order_id, customer_id, order_datetime,
            case when order_id % 5 = 0 then order_total + 100 else order_total end as order_total
          from shop_orders where order_id % 7 <> 0 and (order_id % 11 = 0 or order_id in (select order_id from is_open))),
        made as (
          select order_id, {_score()} as p, case when order_id % 5 = 0 or order_id % 7 = 0 then '{LATER_TS}' else '{RUN_TS}' end as t
          from open_orders
          union all
          select order_id, {_score()}, '{RUN_TS}' from before where order_id not in (select order_id from is_open))
        select order_id, 0.0::double as late_delivery_probability, 0 as predicted_late_delivery, {_r2('p', 'fraud_probability')},
          cast(p >= 0.5 as int) as predicted_fraud, strftime(cast(t as timestamp), {TIME}) as prediction_timestamp from made
        union all
        select order_id, late_delivery_probability, predicted_late_delivery, {_r('fraud_probability')}, predicted_fraud,
          strftime(prediction_timestamp, {TIME}) from order_predictions where order_id not in (select order_id from made)""",
    "order_lines_parse": """select p.request_id, cast(line_no as int) as line_no, product_id, quantity,
        cast(coalesce(ok, false) as int) as lines_ok
        from parsed p left join lines l on l.request_id = p.request_id
        left join line_state s on s.request_id = p.request_id""",
    "order_intake": f"""select request_id, {_t('requested_at')}, customer_id, status,
        case when status = 'accepted' then round(total @shown) end as order_total,
        cast(case when status = 'accepted' then n_lines else 0 end as int) as n_lines from decided""",
    "place_orders": _PLACED,
    "intake_stream": _PLACED,
    "cart_preview": """select p.request_id, cast(coalesce(n_lines, 0) as int) as n_lines,
        round(coalesce(total, 0) @shown) as preview_total, cast(coalesce(any_ok, false) as int) as can_submit
        from parsed p left join line_state s on s.request_id = p.request_id""",
    "contract_audit": _audit(),
    "table_profile": _profile(),
    "run_log_summary": _LOGS,
}


def _shown(body: str) -> str:
    """Each `round(x @shown)` as `x` rounded by way of decimals. Adding zero turns a negative zero into zero."""
    while (end := body.find("@shown)")) >= 0:
        start, depth = end, 1
        while depth:
            start -= 1
            depth += {")": 1, "(": -1}.get(body[start], 0)
        x = body[start + 1:end].strip()
        rounded = f"(cast(round(cast({x} as decimal(38, {DIGITS + 3})), {DIGITS}) as double) + 0e0)"
        body = body[:start].removesuffix("round") + rounded + body[end + len("@shown)"):]
    return body


def oracle_sql() -> dict[str, str]:
    return {name: MAPPED + _shown(body) for name, body in (BODIES | _model_bodies()).items()}

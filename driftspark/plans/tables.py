"""Contracts, payloads and source files derived from the driver tables.

Every derived row comes from one row of a table, so the work of a query grows with its tables. The
expressions are portable SQL: the same text describes an input to Spark and to the checking engine,
while what is computed from the input is written separately for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.model import ENDPOINT, Contract, as_nodes
from driftspark.session import dealt, settle

Spec = list[dict[str, str]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    found = table(spark, sf_dir, name)
    return dealt(found.select(*columns) if columns else found, counted=name != "documents")


def inline(spec: Spec) -> str:
    """Spark: one output row per entry of the spec."""
    structs = ["named_struct(" + ", ".join(f"'{k}', {v}" for k, v in row.items()) + ")" for row in spec]
    return f"inline(array({', '.join(structs)}))"


def unnest(spec: Spec) -> str:
    """The same rows for the checking engine."""
    structs = ["{" + ", ".join(f"'{k}': {v}" for k, v in row.items()) + "}" for row in spec]
    return f"unnest([{', '.join(structs)}], recursive := true)"


# --- payloads -------------------------------------------------------------------------------------

EVENT_PAYLOAD = {
    "owner": "'shop'",
    "app": "'tracker'",
    "method": "CASE WHEN event_type = 'signup' THEN 'POST' WHEN event_type = 'error' THEN 'DELETE' ELSE 'GET' END",
    "path": "concat('/api/events/', event_type)",
    "status": "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END",
    "content_type": "CASE WHEN value > 40 THEN 'text/html' WHEN value > 30 THEN NULL ELSE 'application/json; charset=utf-8' END",
    "body": "CASE WHEN value < 1 THEN substr(props, 1, 5) WHEN value > 15 "
    "THEN concat(substr(props, 1, length(props) - 1), ', \"high\": true}') ELSE props END",
}

ORDER_PAYLOAD = {
    "owner": "o_orderstatus",
    "app": "o_orderpriority",
    "method": "'GET'",
    "path": "'/api/orders/[id]'",
    "body": "concat('{\"id\":', cast(o_orderkey as varchar(20)), "
    "CASE WHEN o_totalprice > 400000 THEN ',\"total\":\"high\"' WHEN o_orderstatus = 'P' THEN ',\"total\":null' "
    "ELSE concat(',\"total\":', cast(o_totalprice as varchar(30))) END, "
    "CASE WHEN o_orderpriority < '3' THEN concat(',\"note\":\"', o_orderpriority, '\"') ELSE '' END, "
    "',\"customer\":{\"id\":', cast(o_custkey as varchar(20)), ',\"vip\":', CASE WHEN o_totalprice > 300000 THEN 'true' ELSE 'false' END, "
    "',\"c2\":{\"c3\":{\"c4\":{\"c5\":{\"c6\":{\"c7\":{\"c8\":1}}}}}}}', "
    "CASE WHEN o_orderstatus = 'O' THEN ',\"tags\":[]' ELSE ',\"tags\":[{\"t\":1.0,\"u\":[true]},{\"v\":2}]' END, '}')",
}


def payload_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "events", "ts", "event_id", "event_type", "value", "props").selectExpr("ts", "event_id", *payload_sql_list(EVENT_PAYLOAD))


# Which events publish a version of the contract of their app, and when: several in one hour, and none before the second.
EVENT_VERSION = {
    "owner": "'shop'",
    "app": "'tracker'",
    "version": "event_id",
    "generated_at": "date_trunc('hour', ts) + INTERVAL '1' HOUR",
    "codes": "user_id % 3",
    "known": "user_id % 5",
}
EVENT_PUBLISHES = "value > 100"


def _event_endpoint(ordinal: str, method: str, path: str, codes: str) -> dict[str, str]:
    return {"ordinal": ordinal, "method": f"'{method}'", "path": f"'/api/events/{path}'", "status_codes": codes}


EVENT_ENDPOINTS = [
    _event_endpoint("0", "GET", "click", "array(200)"),
    _event_endpoint("1", "GET", "purchase", "CASE WHEN known = 0 THEN array(201) ELSE array(200, 201) END"),
    _event_endpoint("2", "POST", "signup", "array(200, 422)"),
    # The last of two endpoints of one name counts.
    _event_endpoint("3", "DELETE", "error", "array(204)"),
    _event_endpoint("4", "DELETE", "error", "CASE WHEN codes = 0 THEN array(200) ELSE array(404, 500) END"),
]


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(EVENT_PUBLISHES).selectExpr(*payload_sql_list(EVENT_VERSION))


def order_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "orders").selectExpr("o_orderdate AS ts", *payload_sql_list(ORDER_PAYLOAD))


def payload_sql_list(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


# --- two contract versions, one endpoint per order ------------------------------------------------

ENDPOINT_OF_ORDER = {
    "owner": "o_orderpriority",
    "app": "concat('app-', cast(o_custkey as varchar(20)))",
    "method": "CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'POST' ELSE 'PUT' END",
    "path": "concat('/api/orders/', cast(o_orderkey as varchar(20)), '/[id]')",
}
OLD_ORDERS = "o_orderdate < timestamp '2001-02-01 00:00:00'"
NEW_ORDERS = "o_orderdate >= timestamp '1995-07-01 00:00:00'"
DESCRIPTION_OLD = "CASE WHEN o_totalprice > 300000 THEN 'Big order.' WHEN o_totalprice > 100000 THEN 'Order.' END"
DESCRIPTION_NEW = "CASE WHEN o_totalprice > 450000 THEN '' WHEN o_totalprice > 200000 THEN 'Big order.' END"
CODES_OLD = {"F": [200, 404], "O": [201, 400, 400], "P": [200]}
CODES_NEW = {"F": [200], "O": [201, 409], "P": [200, 202]}


def _field(location: str, name: str, kind: str, required: str = "false", there: str = "true") -> dict[str, str]:
    return {
        "location": f"'{location}'", "name": f"'{name}'", "type": f"cast({kind} as varchar(20))",
        "required": f"({required})", "there": f"({there})",
    }


_LOW, _BIG, _F, _O, _P = (
    "o_orderpriority < '3'", "o_totalprice > 250000", "o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderstatus = 'P'",
)
OLD_FIELDS: Spec = [
    _field("body", "", "'object'", there=f"NOT {_F}"),
    _field("body", "customer", "'string'", _BIG, f"NOT {_F}"),
    _field("body", "amount", "'number'", "true", f"NOT {_F}"),
    _field("body", "legacy", "'string'", _LOW, f"NOT {_F} AND {_BIG}"),
    _field("query", "", "'object'", there=_LOW),
    _field("query", "page", "'string'", "false", _LOW),
    _field("response", "", "'object'"),
    _field("response", "id", "'string'", "true"),
    _field("response", "total", f"CASE WHEN {_LOW} THEN 'unknown' ELSE 'number' END"),
    _field("response", "status", f"CASE WHEN {_P} THEN NULL ELSE 'string' END", _BIG),
    _field("response", "memo", "'string'", "false", _O),
    _field("path", "", "'object'"),
    _field("path", "id", "'string'", "true"),
]
NEW_FIELDS: Spec = [
    _field("body", "", "'object'", there=f"NOT {_O}"),
    _field("body", "customer", "'object'", _LOW, f"NOT {_O}"),
    _field("body", "amount", "'integer'", "true", f"NOT {_O} AND {_BIG}"),
    _field("body", "coupon", "'string'", _LOW, f"NOT {_O}"),
    _field("query", "", "'object'", there=_BIG),
    _field("query", "page", "'string'", f"NOT {_F}", _BIG),
    _field("response", "", f"CASE WHEN o_totalprice > 480000 THEN NULL ELSE 'object' END"),
    _field("response", "id", "'string'", _F, "o_totalprice <= 480000"),
    _field("response", "total", f"CASE WHEN {_BIG} THEN 'unknown' ELSE 'integer' END", "true", "o_totalprice <= 480000"),
    _field("response", "status", "'integer'", "true", "o_totalprice <= 480000"),
    _field("response", "eta", "'string'", "true", f"{_F} AND o_totalprice <= 480000"),
    _field("path", "", "'object'"),
    _field("path", "ident", "'string'", "true"),
]


def _codes(by_status: dict[str, list[int]], array: str, close: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {array}{', '.join(map(str, v))}{close}" for k, v in by_status.items())
    return f"CASE o_orderstatus {cases} END"


def contract_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that contracts are made of, dealt out and written once: contracts are read several times."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return settle(spread(spark, sf_dir, "orders", *columns), "orders")


def order_versions(spark: SparkSession, sf_dir: str) -> tuple[Contract, Contract]:
    """Both versions, from one copy of the columns they are made of."""
    orders = contract_orders(spark, sf_dir)
    return order_contract(spark, sf_dir, new=False, orders=orders), order_contract(spark, sf_dir, new=True, orders=orders)


def order_contract(spark: SparkSession, sf_dir: str, new: bool, everything: bool = False, orders: DataFrame | None = None) -> Contract:
    """One of two versions, each without the orders of a period (so that endpoints come and go), or the fields
    of one on all orders."""
    orders = contract_orders(spark, sf_dir) if orders is None else orders
    if not everything:
        orders = orders.where(NEW_ORDERS if new else OLD_ORDERS)
    endpoint = payload_sql_list(ENDPOINT_OF_ORDER)
    endpoints = orders.selectExpr(
        *endpoint, "0 AS ordinal", f"{_codes(CODES_NEW if new else CODES_OLD, 'array(', ')')} AS status_codes",
        f"{DESCRIPTION_NEW if new else DESCRIPTION_OLD} AS description",
    )
    nodes = orders.selectExpr(*endpoint, inline(NEW_FIELDS if new else OLD_FIELDS)).where("there")
    return Contract(endpoints, as_nodes(_with_path(nodes)))


def _with_path(nodes: DataFrame) -> DataFrame:
    path = F.when(F.col("name") == "", F.array().cast("array<string>")).otherwise(F.array("name"))
    return nodes.withColumn("node_path", path).withColumn("trail", F.when(F.col("name") == "", "").otherwise("p"))


# Responses with alternatives: their labels in order, by order status. A single one is a response without a choice.
ALTERNATIVES_OLD = {"F": ["id", "error"], "O": ["id", "error", "list"], "P": ["id"]}
ALTERNATIVES_NEW = {"F": ["error", "id"], "O": ["list", "id"], "P": ["error", "id"]}


def alternatives_sql(by_status: dict[str, list[str]], array: str, close: str) -> str:
    """Labels of the alternatives of an order."""
    cases = " ".join(f"WHEN '{k}' THEN {array}{', '.join(repr(x) for x in v)}{close}" for k, v in by_status.items())
    return f"CASE o_orderstatus {cases} END"


def alternative_contract(spark: SparkSession, sf_dir: str, new: bool, orders: DataFrame | None = None) -> Contract:
    """One endpoint per order whose response is one of several schemas; a single one is no ``oneOf``."""
    labels = alternatives_sql(ALTERNATIVES_NEW if new else ALTERNATIVES_OLD, "array(", ")")
    orders = (contract_orders(spark, sf_dir) if orders is None else orders).selectExpr(
        *payload_sql_list(ENDPOINT_OF_ORDER), f"{labels} AS labels", "o_orderpriority < '3' AS low", f"{str(new).lower()} AND o_totalprice > 400000 AS big"
    )
    endpoints = orders.selectExpr(*ENDPOINT, "0 AS ordinal", "array(200) AS status_codes", "cast(null as string) AS description")
    choice = "size(labels) > 1"
    nodes = orders.selectExpr(*ENDPOINT, "low", "big", "size(labels) > 1 AS choice", "posexplode(labels) AS (pos, label)")
    at = "CASE WHEN choice THEN array(concat('oneOf#', cast(pos as string))) ELSE cast(array() as array<string>) END"
    root = orders.where(choice).selectExpr(*ENDPOINT, "cast(array() as array<string>) AS node_path", "'' AS trail", "cast(null as string) AS type")
    own = nodes.selectExpr(
        *ENDPOINT, f"{at} AS node_path", "CASE WHEN choice THEN 'o' ELSE '' END AS trail", "CASE label WHEN 'list' THEN 'array' ELSE 'object' END AS type"
    )
    # Alternatives differ by their fields; error fields of big orders change their type in the new version.
    below = nodes.selectExpr(
        *ENDPOINT, f"concat({at}, array(CASE label WHEN 'list' THEN '[]' ELSE concat(label, CASE WHEN low THEN '_low' ELSE '' END) END)) AS node_path",
        "concat(CASE WHEN choice THEN 'o' ELSE '' END, CASE label WHEN 'list' THEN 'i' ELSE 'p' END) AS trail",
        "CASE WHEN label = 'error' AND big THEN 'integer' ELSE 'string' END AS type",
    )
    whole = root.unionByName(own).unionByName(below).withColumn("location", F.lit("response"))
    return Contract(endpoints, as_nodes(whole))


def contract_ctes() -> str:
    """CTEs old_e, new_e, old_n, new_n of the same contracts, and all_n on all orders, for the checking engine."""
    endpoint = payload_sql(ENDPOINT_OF_ORDER)
    parts = [f"all_n AS (SELECT * FROM (SELECT {endpoint}, {unnest(NEW_FIELDS)} FROM orders) WHERE there)"]
    for side, where, codes, text, fields in (
        ("old", OLD_ORDERS, CODES_OLD, DESCRIPTION_OLD, OLD_FIELDS), ("new", NEW_ORDERS, CODES_NEW, DESCRIPTION_NEW, NEW_FIELDS),
    ):
        parts.append(
            f"{side}_e AS (SELECT {endpoint}, {_codes(codes, '[', ']')} AS codes, {text} AS description FROM orders WHERE {where})"
        )
        parts.append(f"{side}_n AS (SELECT * FROM (SELECT {endpoint}, {unnest(fields)} FROM orders WHERE {where}) WHERE there)")
    return ", ".join(parts)


# Nested arrays: each order's key below o_custkey % 15 arrays.
DEEP_PAYLOAD = {
    "owner": "'shop'", "app": "'deep'", "method": "'GET'", "path": "concat('/deep/', cast(o_custkey % 15 as varchar(5)))",
    "body": "concat(repeat('[', cast(o_custkey % 15 as int)), '{\"id\":', cast(o_orderkey as varchar(20)), '}', repeat(']', cast(o_custkey % 15 as int)))",
}


def deep_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "orders").selectExpr("o_orderdate AS ts", *payload_sql_list(DEEP_PAYLOAD))


# --- baseline and observed schemas, one endpoint per part -----------------------------------------

ENDPOINT_OF_PART = {
    "owner": "p_brand",
    "app": "p_type",
    "method": "'GET'",
    "path": "concat('/api/parts/', cast(p_partkey as varchar(20)))",
}
_NO_BASE, _UNKNOWN, _SAMPLED = "p_size <= 8", "p_size > 8 AND p_size <= 16", "p_size > 40"
_IN_BASE = "p_size > 16"


def _node(path: str, trail: str, kind: str, there: str, source: str = "NULL") -> dict[str, str]:
    return {
        "p": f"'{path}'", "trail": f"'{trail}'", "type": f"cast({kind} as varchar(20))", "there": f"({there})",
        "source": f"cast({source} as varchar(20))",
    }


BASE_NODES: Spec = [
    _node("", "", f"CASE WHEN {_UNKNOWN} THEN 'unknown' ELSE 'object' END", f"NOT ({_NO_BASE})", f"CASE WHEN {_SAMPLED} THEN 'sampled' END"),
    _node("name", "p", "'string'", _IN_BASE),
    _node("price", "p", "'number'", _IN_BASE),
    _node("size", "p", "CASE WHEN p_type = 'PROMO' THEN 'unknown' ELSE 'integer' END", _IN_BASE),
    _node("old", "p", "'string'", f"{_IN_BASE} AND p_retailprice > 950", "CASE WHEN p_type = 'SMALL' THEN 'sampled' END"),
    _node("dims", "p", "'object'", _IN_BASE, "CASE WHEN p_type = 'LARGE' THEN 'sampled' END"),
    _node("dims/w", "pp", "'number'", _IN_BASE),
    _node("dims/d", "pp", "'number'", _IN_BASE),
    _node("tags", "p", "'array'", _IN_BASE),
    _node("tags/[]", "pi", "CASE WHEN p_type = 'PROMO' THEN 'unknown' WHEN p_type = 'SMALL' THEN NULL ELSE 'object' END", _IN_BASE),
    _node("tags/[]/t", "pip", "'string'", f"{_IN_BASE} AND p_type <> 'PROMO' AND p_type <> 'SMALL'"),
]
_SEEN = "p_retailprice < 990"
OBSERVED_NODES: Spec = [
    _node("", "", "'object'", _SEEN),
    _node("name", "p", "'string'", _SEEN),
    _node("price", "p", "CASE WHEN p_size > 30 THEN 'integer' ELSE 'number' END", _SEEN),
    _node("size", "p", "'integer'", _SEEN),
    _node("brand", "p", "'object'", f"{_SEEN} AND p_size < 45"),
    _node("brand/id", "pp", "'string'", f"{_SEEN} AND p_size < 45"),
    _node("dims", "p", "CASE WHEN p_size = 20 THEN 'string' ELSE 'object' END", _SEEN),
    _node("dims/w", "pp", "'number'", f"{_SEEN} AND p_size <> 20"),
    _node("dims/h", "pp", "'number'", f"{_SEEN} AND p_size <> 20"),
    _node("tags", "p", "'array'", _SEEN),
    _node("tags/[]", "pi", "'object'", _SEEN),
    _node("tags/[]/t", "pip", "'string'", _SEEN),
    _node("tags/[]/u", "pip", "'null'", _SEEN),
]


def part_nodes(spark: SparkSession, sf_dir: str, observed: bool) -> DataFrame:
    parts = spread(spark, sf_dir, "part").selectExpr(
        *payload_sql_list(ENDPOINT_OF_PART), inline(OBSERVED_NODES if observed else BASE_NODES)
    )
    path = F.when(F.col("p") == "", F.array().cast("array<string>")).otherwise(F.split("p", "/"))
    nodes = parts.where("there").withColumn("node_path", path).withColumn("location", F.lit("response"))
    return as_nodes(nodes)


def wide_nodes(spark: SparkSession, sf_dir: str, observed: bool) -> DataFrame:
    """One endpoint whose response is an object with a property for every order key, an object sampled before;
    the code and the samples know two thirds of the keys each."""
    orders = spread(spark, sf_dir, "orders").where(f"o_orderkey % 3 <> {1 if observed else 0}")
    kind = "CASE WHEN o_orderstatus = 'O' THEN 'integer' ELSE 'string' END" if observed else "'string'"
    place = "'shop' AS owner", "'wide' AS app", "'GET' AS method", "'/ids' AS path", "'response' AS location"
    ids = orders.selectExpr(*place, "array(concat('k', cast(o_orderkey as string))) AS node_path", "'p' AS trail", f"{kind} AS type", "cast(null as string) AS source")
    roots = orders.selectExpr(*place, "cast(array() as array<string>) AS node_path", "'' AS trail", "'object' AS type", f"{'null' if observed else repr('sampled')} AS source")
    return as_nodes(ids.unionByName(roots.distinct()))


def part_ctes() -> str:
    endpoint = payload_sql(ENDPOINT_OF_PART)
    return ", ".join(
        f"{name} AS (SELECT * FROM (SELECT {endpoint}, {unnest(spec)} FROM part) WHERE there)"
        for name, spec in (("b", BASE_NODES), ("o", OBSERVED_NODES))
    )


# --- source files, one per part -------------------------------------------------------------------

FILE_OF_PART = {
    "repo": "concat('org/', replace(p_brand, '#', '-'))",
    "rel_path": "CASE WHEN p_size <= 20 THEN concat('app/api/parts/p', cast(p_partkey as varchar(20)), "
    "CASE WHEN p_size <= 5 THEN '/[id]/[...rest]' WHEN p_size <= 10 THEN '/[id]' ELSE '' END, '/route.', CASE WHEN p_type = 'PROMO' THEN 'js' ELSE 'ts' END) "
    "WHEN p_size <= 40 THEN concat('pages/api/', p_type, '/p', cast(p_partkey as varchar(20)), "
    "CASE WHEN p_size <= 25 THEN '/index.ts' WHEN p_size <= 30 THEN '/[id].js' WHEN p_size <= 32 THEN '/_middleware.ts' ELSE '.ts' END) "
    "WHEN p_size <= 45 THEN concat('src/p', cast(p_partkey as varchar(20)), '.tsx') "
    "ELSE concat('node_modules/lib/p', cast(p_partkey as varchar(20)), '.js') END",
    "content": "CASE WHEN p_size <= 20 THEN concat('import x from \"x\";', chr(10), '/** ', p_name, '. Part of ', p_brand, ' */', chr(10), "
    "CASE WHEN p_type = 'ECONOMY' THEN concat('export async function GET(req) {', chr(10), '  const q = req.nextUrl.searchParams.get(\"', p_brand, '\");', chr(10), "
    "'  return NextResponse.json({ q }, { status: ', cast(200 + p_size as varchar(10)), ' });', chr(10), '}', chr(10), "
    "'export function DELETE() { return Response.json({}); }') "
    "WHEN p_type = 'PROMO' THEN 'export const POST = withAuth(handle);' "
    "WHEN p_type = 'SMALL' THEN 'export const revalidate = 60;' "
    "ELSE 'export const PUT = async () => { return Response.json({ ok: 1 }); };' END) "
    "ELSE concat('/** Handler for ', p_name, ' */', chr(10), CASE WHEN p_type = 'SMALL' THEN 'export const a = 1;' "
    "WHEN p_type = 'PROMO' THEN 'export default (req, res) => res.json({ a: req.query.size, b: req.query.id });' "
    "ELSE concat('export default async function handler(req, res) {', chr(10), '  const { id, page } = req.query;', chr(10), "
    "'  if (req.method === \"GET\") return res.status(', cast(200 + p_size as varchar(10)), ').json({ page });', chr(10), "
    "CASE WHEN p_type = 'LARGE' THEN '  if (req.method !== \"PATCH\") return res.status(405).json({});' ELSE '' END, chr(10), '}') END) END",
}


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "part").selectExpr(*payload_sql_list(FILE_OF_PART))


# Handlers whose comments, strings, templates and brackets look like signals; ``7xx`` stands for a status of
# the part. The rows expected of each case are stated in ``oracle.HANDLER_SIGNALS``.
HANDLER_CASES = [
    # 0: commented code
    """/* export function PUT() {} */
/** Lists "parts". Never NextResponse.json({}, { status: 410 }). */
export async function GET(req) {
  // return NextResponse.json({ gone: true }, { status: 411 });
  /* const old = req.nextUrl.searchParams.get("old"); */
  const q = req.nextUrl.searchParams.get("q"); // searchParams.get('r')
  return NextResponse.json({ q }, { status: 7xx });
}
""",
    # 1: calls in strings, a string with brackets and quotes
    """export async function POST(req) {
  const text = "NextResponse.json({}, { status: 412 }) } // \\" {";
  const other = 'export async function GET() { return Response.json({}); }';
  return NextResponse.json({ text, other, tail: "})" }, { status: 7xx });
}
""",
    # 2: nested braces in both arguments, properties named status that are not the option
    """export async function GET(req) {
  if (!req) return NextResponse.json({ status: 413, of: { status: 414 } }, { headers: { status: "415", x: f({ status: 416 }) }, status: 7xx });
  return Response.json(wrap([{ a: { b: [1, 2] } }], { status: 417 }));
}
""",
    # 3: a helper behind the handler, and one in front
    """function before() { return NextResponse.json({}, { status: 418 }); }
/** First. */
/** Second; wins. Not this. */
export const PUT = async (req, { params = {} } = make(1)) => {
  return NextResponse.json({ id: params.id }, { status: 7xx })
};
const after = (req) => NextResponse.json({ n: req.nextUrl.searchParams.get("hidden") }, { status: 419 });
""",
    # 4: templates and regular expressions
    """export async function GET(req) {
  const url = `a } ${req.nextUrl.searchParams.get('page')} searchParams.get("none") {`;
  const clean = url.replace(/["'`({]/g, "");
  return NextResponse.json({ clean, not: `Response.json({}, { status: 420 })` }, { status: 7xx });
}
export async function DELETE(req) {
  return Response.json({ name: req.nextUrl.searchParams.get(name), it: searchParams.get(`no`) });
}
""",
    # 5: a status that is no number of its own
    """export async function GET(req) {
  const { searchParams } = new URL(req.url);
  const a = searchParams.get("it's, (a) \\"name\\""), b = searchParams.get('b');
  if (a) return NextResponse.json({ a }, b ? { status: 421 } : { status: 422 });
  if (b) return NextResponse.json({ b }, init({ status: 423 }));
  return NextResponse.json({ a, b }, { status: "424" }, { status: 425 });
}
""",
    # 6: wrapped, and an export that is only a comment
    """// export const DELETE = async () => {};
export const POST = withAuth(async () => NextResponse.json({}, { status: 426 }));
""",
    # 7: no response, arrow without a body
    """/* Plain comment. */
export const GET = async req => req.nextUrl
  .searchParams.get("x");
export async function PATCH(): Promise<{ a: { b: 1 } }> {
  return { status: 427 };
}
""",
]


def handler_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an App Router file of one of the cases, with a status of its own."""
    text = F.array(*[F.lit(case) for case in HANDLER_CASES])[(F.col("p_partkey") % len(HANDLER_CASES)).cast("int")]
    status = (F.lit(500) + F.col("p_size")).cast("string")
    return spread(spark, sf_dir, "part").select(
        F.concat(F.lit("org/"), "p_type").alias("repo"),
        F.concat(F.lit("app/api/h"), F.col("p_partkey").cast("string"), F.lit("/route.ts")).alias("rel_path"),
        F.replace(text, F.lit("7xx"), status).alias("content"),
    )


def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two App files and one Pages file per part that declare the same endpoint."""
    paths = "array('app/api/p{0}/route.js', 'app/api/p{0}/route.ts', 'pages/api/p{0}.ts')".replace("{0}", "', cast(p_partkey as string), '")
    paths = paths.replace("'app", "concat('app").replace("'pages", "concat('pages").replace(".js'", ".js')").replace(".ts'", ".ts')")
    made = spread(spark, sf_dir, "part").selectExpr("concat('org/', replace(p_brand, '#', '-')) AS repo", "p_size", f"explode({paths}) AS rel_path")
    app = "CASE WHEN p_size > 25 AND rel_path LIKE 'pages/%' THEN 'export const unused = 1;' WHEN rel_path LIKE 'pages/%' THEN 'export default (req, res) => res.json({});' ELSE 'export function GET() { return Response.json({}); }' END AS content"
    return made.selectExpr("repo", "rel_path", app)


def files_cte() -> str:
    return f"f AS (SELECT {payload_sql(FILE_OF_PART)}, part.* FROM part)"


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a source file of the repository named after its language."""
    return spread(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").selectExpr(
        "lang AS repo", "concat('src/', source, '/', cast(doc_id as string), '.ts') AS rel_path", "text AS content"
    )


def benchmark_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken fields: every distinct word of the benchmark texts, in every repository."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("field")
    )
    langs = F.explode(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]))
    return words.distinct().select(langs.alias("repo"), "field")

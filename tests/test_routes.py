import pytest
from conftest import rows
from pyspark.sql import functions as F

from driftspark.model import SOURCE_FILES_DDL, NODES_DDL
from driftspark.operators import routes
from driftspark.plans.workflows import contract_of_corpus

HEALTH = 'import { NextResponse } from "next/server";\n/** Liveness. More text. */\nexport async function GET() {\n  return NextResponse.json({ status: "ok" });\n}\n'
USERS = '''
export async function GET(req: NextRequest) {
  const { searchParams } = new URL(req.url);
  const page = searchParams.get("page") ?? "1";
  const limit = req.nextUrl.searchParams.get('limit');
  return NextResponse.json({ users: list(page), page, limit });
}

/**
 * Create a user
 * with care. And then some.
 * @param req the request
 */
export async function POST(req: NextRequest) {
  const body = await req.json();
  if (!body.name) {
    return NextResponse.json({ error: "no; name" }, { status: 400 });
  }
  return NextResponse.json({ user: make(body) }, { headers: h, status: 201 });
}
'''
USER = '''
export const GET = async (req, { params }) => {
  return Response.json({ user: find(params.id) });
};
export const DELETE = withAuth(async () => Response.json({ deleted: true }, { status: 204 }));
'''
PAGES_USERS = '''
/** Lists or creates. */
export default async function handler(req: NextApiRequest, res: NextApiResponse) {
  if (req.method === "GET") {
    const { page, size: pageSize, id } = req.query;
    return res.status(200).json({ page });
  }
  if (req.method === 'POST') {
    if (!req.query.dry) return res.status(400).json({ error: 1 });
    return res.status(201).json({});
  }
  return res.status(405).json({ error: "no" });
}
'''
PAGES_ID = 'const handler = (req, res) => { switch (req.method) { case "DELETE": return res.json({ id: req.query.id }); case "OPTIONS": return res.status(code).json({}); } };\nexport default handler;\n'

FILES = [
    ("me/app", "app/api/health/route.ts", HEALTH),
    ("me/app", "app/api/users/route.ts", USERS),
    ("me/app", "app/api/users/[id]/route.js", USER),
    ("me/app", "app/api/myroute.ts", HEALTH),
    ("me/app", "app/api/none/route.ts", "export const config = 1;"),
    ("me/app", "app/page.tsx", HEALTH),
    ("me/pages", "pages/api/users/index.ts", PAGES_USERS),
    ("me/pages", "pages/api/users/[id].ts", PAGES_ID),
    ("me/pages", "pages/api/health.ts", "export default (req, res) => res.json({ ok: true });"),
    ("me/pages", "pages/api/_middleware.ts", PAGES_USERS),
    ("me/pages", "pages/api/lib.ts", "export const x = 1;"),
    ("me/both", "app/api/a/route.ts", HEALTH),
    ("me/both", "pages/api/b.ts", PAGES_ID),
    ("me/none", "src/index.ts", "x"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, SOURCE_FILES_DDL)


def test_stack(files):
    assert rows(routes.detect_stack(files)) == [
        ("me/app", "app", "nextjs-app-router"), ("me/both", "hybrid", "nextjs-hybrid"),
        ("me/none", "none", "nextjs-app-router"), ("me/pages", "pages", "nextjs-pages-router"),
    ]


def test_inventory(files):
    found = {(r.repo, r.method, r.path): r for r in routes.route_inventory(files).collect()}
    assert sorted(found) == sorted([
        ("me/app", "GET", "/api/health"), ("me/app", "GET", "/api/users"), ("me/app", "POST", "/api/users"),
        ("me/app", "GET", "/api/users/[id]"), ("me/app", "DELETE", "/api/users/[id]"), ("me/app", "GET", "/api/myroute.ts"),
        ("me/pages", "GET", "/api/users"), ("me/pages", "POST", "/api/users"), ("me/pages", "DELETE", "/api/users/[id]"),
        ("me/pages", "GET", "/api/health"), ("me/both", "GET", "/api/a"), ("me/both", "DELETE", "/api/b"),
    ])
    health = found[("me/app", "GET", "/api/health")]
    assert (health.description, health.status_codes, health.query_names, health.inferability) == ("Liveness.", [200], [], "found")
    assert found[("me/app", "GET", "/api/users")].query_names == ["page", "limit"]
    assert found[("me/app", "GET", "/api/users")].description is None
    post = found[("me/app", "POST", "/api/users")]
    assert (post.status_codes, post.query_names, post.description) == ([400, 201], [], "Create a user\nwith care.")
    assert found[("me/app", "GET", "/api/users/[id]")].status_codes == [200]
    wrapped = found[("me/app", "DELETE", "/api/users/[id]")]
    assert (wrapped.inferability, wrapped.status_codes, wrapped.note) == ("wrapper", [200], routes.WRAPPED)
    for method in ("GET", "POST"):
        row = found[("me/pages", method, "/api/users")]
        assert row.status_codes == [200, 400, 201, 405] and row.branching and row.description == "Lists or creates."
        assert sorted(row.query_names) == ["dry", "id", "page", "pageSize"]
    by_id = found[("me/pages", "DELETE", "/api/users/[id]")]
    assert (by_id.query_names, by_id.status_codes) == ([], [200])
    assert not found[("me/pages", "GET", "/api/health")].branching


@pytest.mark.parametrize("path, expected", [
    ("/a/[id]/b/[...rest]", [("id", "string", None), ("rest", "array", "string")]), ("/a", []), ("/[x][y]", [("x", "string", None), ("y", "string", None)]),
])
def test_path_parameters(spark, path, expected):
    df = spark.createDataFrame([(path,)], "path string")
    assert [tuple(r) for r in routes.path_parameters(df).orderBy("ordinal").select("name", "type", "items_type").collect()] == expected


def test_resolve_paths(spark):
    df = spark.createDataFrame(
        [("/a/[id]/[...rest]", {"id": "7$1[x]"}), ("/a/[id]", {"id": "1"}), ("/plain", {}), ("[a][b]", {"a": "[b]", "b": "z"})],
        "path string, params map<string,string>")
    assert rows(routes.resolve_paths(df, F.col("params")), "path", "resolved", "missing") == sorted([
        ("/a/[id]/[...rest]", "/a/7$1[x]/[...rest]", ["...rest"]), ("/a/[id]", "/a/1", []), ("/plain", "/plain", []),
        ("[a][b]", "[b]z", []),
    ], key=repr)


def test_contract_of_corpus(spark, files):
    contract = contract_of_corpus(files)
    assert contract.nodes.schema.simpleString() == spark.createDataFrame([], NODES_DDL).schema.simpleString()
    found = rows(contract.nodes.where("app = 'app' and path = '/api/users/[id]' and method = 'GET'"), "location", "node_path", "type", "required")
    assert found == sorted([("path", [], "object", False), ("path", ["id"], "string", True), ("response", [], "unknown", False)], key=repr)
    assert contract.endpoints.where("owner = 'me'").count() == 12


def test_long_files_do_not_overflow(spark):
    long = "/** " + "* x\n" * 30000 + " */ const a = 1;\n" + "foo({a: 1});\n" * 30000 + HEALTH
    df = spark.createDataFrame([("r", "app/api/x/route.ts", long)], SOURCE_FILES_DDL)
    row = routes.route_inventory(df).first()
    assert (row.description, row.status_codes) == ("Liveness.", [200])


def test_status_numbers_are_never_replaced(spark):
    import pyspark.sql.functions as F

    app = "{ Response.json({}, { status: 12345678901 }); Response.json({}, { status: 404 }); Response.json({}); }"
    pages = "res.status(12345678901).json({}); res.status(code).json({}); res.status(1234567).json({});"
    df = spark.createDataFrame([(app, pages)], "a string, p string")
    row = df.select(routes.app_status_codes(F.col("a")).alias("a"), routes.pages_status_codes(F.col("p")).alias("p")).first()
    assert (row["a"], row["p"]) == ([404, 200], [200, 1234567])


def lex(spark, text):
    from driftspark.functions.lexer import lexed

    return spark.createDataFrame([(text,)], "t string").select(lexed(F.col("t"))).first()[0]


@pytest.mark.parametrize("source, code", [
    ("a // b\nc", "a  \nc"), ("a /* b\n */ c", "a \n c"), ("/**/x", " x"), ("/** d */x", "/*206420*/x"), ("a /* open", "a  "),
    ("f('a\\'b', \"(\")", 'f("612762", "28")'), ("'open\n\"x\"", "'open\n\"78\""), ("`a(` + `b${c({d: 1})}e`", "`` + (c({d: 1}))"),
    ("x = /[/\"](/g; y", "x = 0; y"), ("a / b / c", "a / b / c"), ("\"//\" // '", '"2F2F"  '), ("", ""), (None, None), ("\"é\"", '"C3A9"'),
])
def test_lexed(spark, source, code):
    assert lex(spark, source) == code


def test_brackets_by_depth(spark):
    from driftspark.functions import lexer

    df = spark.createDataFrame([("a(b[c])) => d", "function f(a: {b: 1}): {c: 1} {\nconst x = 1\n}\nconst y = 2", "f(x, y), {a: {b: 1, c}, d: 2}, e) + g, h")], "a string, s string, c string")
    row = df.select(lexer.after_close(F.col("a")), lexer.statement(F.col("s")), lexer.second_argument(F.col("c"))).first()
    assert tuple(row) == (" => d", "function f(a: {b: 1}): {c: 1} {\nconst x = 1\n}", ", {a: , d: 2}")
    assert spark.createDataFrame([("a(b",)], "a string").select(lexer.after_close(F.col("a"))).first()[0] == ""


def test_long_tokens_and_many_brackets(spark):
    body = "  const a = \"" + "x\\\"(" * 100_000 + "\"; /* " + "* (" * 100_000 + " */\n" + "  f({ a: [1, (2)] }, `${b}`);\n" * 20_000
    text = "export async function GET(req) {\n" + body + "  return Response.json({}, { status: 418 });\n}\n"
    row = routes.route_inventory(spark.createDataFrame([("r", "app/api/x/route.ts", text)], SOURCE_FILES_DDL)).first()
    assert (row.inferability, row.status_codes, row.query_names) == ("found", [418], [])

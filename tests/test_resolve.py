"""Resolution of calls and URLs: the shapes that tell the rules apart."""

from graphloom.operators import graph as g
from graphloom.operators.resolve import resolve_apis, resolve_services
from graphloom.model import Graph

APIS = [("get", "GET", "/api/v1/users/{id}", [], "users-service"), ("list", "GET", "/api/v1/users", [], "users-service"), ("charge", "POST", "/api/v1/charge", [], "billing-service")]
VAGUE = ("any", "GET", "/{a}/{b}/{c}/{d}", [], None)


def apis_of(spark, url, method="GET", apis=APIS, template=False, **more):
    calls = spark.createDataFrame([(1, method, url, template)], "call_id int, method string, url string, is_template boolean")
    r = resolve_apis(calls, spark.createDataFrame(apis, "api_id string, method string, template string, hosts array<string>, service string"), **more).first()
    return r["api_id"], r["confidence"], r["reason"]


def test_calls_to_apis(spark):
    hosts = {"users-service": ["users-service.internal"]}
    url = "https://users-service.internal/api/v1/users/42"
    assert apis_of(spark, url, service_hosts=hosts) == ("get", "HIGH", "exact-host+path")
    assert apis_of(spark, url, apis=[*APIS, VAGUE], service_hosts=hosts) == ("get", "MEDIUM", "exact-host+path")
    assert apis_of(spark, "https://billing-service.cluster.local/api/v1/charge", "post") == ("charge", "MEDIUM", "fuzzy-host+path")
    assert apis_of(spark, "{var}/api/v1/users/{var}", template=True) == ("get", "MEDIUM", "template-path-unique")
    assert apis_of(spark, "${BASE}/api/v1/users/42", apis=[VAGUE, *APIS]) == ("get", "MEDIUM", "template-path-multi")
    assert apis_of(spark, "/api/{var}/users/42?x=1") == ("get", "MEDIUM", "template-path-unique")
    assert apis_of(spark, "https://x.io/totally/different") == (None, None, "no-match")
    assert apis_of(spark, "not a url") == apis_of(spark, None) == (None, None, "no-match")
    assert apis_of(spark, "https://unknown.host.example.org/api/v1/users/9") == ("get", "LOW", "path-only-no-host-match")
    assert apis_of(spark, "https://unknown.host.example.org/api/v1/users/9", strict=True) == (None, None, "path-only-no-host-match")


def test_urls_to_services(spark):
    services = spark.createDataFrame([(1, "user-service"), (2, "pay-service"), (3, "auth"), (4, "Order_API"), (5, None), (6, "")], "service_id int, name string")
    want = {
        "http://user-service/api": (1, "HIGH"), "http://USER-service:3000/x": (1, "HIGH"), "http://user-service.default.svc.cluster.local/api": (1, "HIGH"),
        "https://user-service-v2.example.com": (1, "HIGH"), "https://pay-service.example.com/x": (2, "HIGH"), "http://service/x": (None, None),
        "${USER_SERVICE_URL}/api": (1, "HIGH"), "${PAY_URL}/api": (None, None), "${AUTH_HOST}/login": (3, "HIGH"), "${SERVICE_URL}/x": (None, None),
        "https://gw.example.com/order-api/x": (4, "MEDIUM"), "https://gw.example.com/pay_service/1": (2, "MEDIUM"), "/local/path": (None, None), "": (None, None), None: (None, None),
    }
    urls = spark.createDataFrame(list(enumerate(want)), "url_id int, url string")
    got = {r["url_id"]: (r["service_id"], r["confidence"]) for r in resolve_services(urls, services).collect()}
    assert got == dict(enumerate(want.values()))


def test_service_edges(spark):
    nodes = [(x, "Service", x, None) for x in "abcd"] + [("t1", "Table", "t1", None), ("f", "Function", "f", None)]
    edges = [
        ("a", "q1", "PRODUCES"), ("a", "q2", "PRODUCES"), ("b", "q1", "CONSUMES"), ("b", "q2", "CONSUMES"), ("c", "q2", "CONSUMES"), ("a", "q1", "CONSUMES"), ("d", "q2", "PRODUCES"),
        ("a", "api", "EXPOSES"), ("c", "api", "CALLS_API"), ("a", "t1", "OWNS"), ("f", "t1", "QUERIES"), ("file", "f", "DEFINES"), ("d", "file", "CONTAINS"),
    ]
    graph = Graph(spark.createDataFrame(nodes, "id string, label string, name string, path string"), spark.createDataFrame([(*e, None) for e in edges], "src string, dst string, type string, confidence string"))
    got = {(r["from_id"], r["to_id"], r["kind"], r["n"]) for r in g.service_edges(graph).collect()}
    topics = {("a", "b", 2), ("a", "c", 1), ("d", "b", 1), ("d", "c", 1)}
    assert got == {(x, y, "PRODUCES", n) for x, y, n in topics} | {(y, x, "CONSUMES", n) for x, y, n in topics} | {("c", "a", "CALLS_API", 1), ("a", "d", "SHARED_TABLE", 1)}

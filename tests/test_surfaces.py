"""What files expose, on small files."""

from siftkite.operators import surfaces as S


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_ports(spark):
    df = files(spark, [("a.yml", "# port: 1\nhttps: x port: 8443\n"), (".env", "PORT=1"), ("b.env", "PORT=80"), ("c.PY", "app.run(port=5000)\n@app.route('/')"), ("d.js", "app.listen(process.env.PORT)"), ("e.yml", None), ("f.md", "port: 1")])
    got = {tuple(r) for r in S.scan_ports(df).collect()}
    assert got == {
        ("a.yml", 2, "8443", "https", "config_yaml", "static", "yaml_port"),
        ("b.env", 1, "80", "unknown", "config_env", "static", "env_port"),
        ("c.PY", 1, "5000", "http", "code_python_flask", "static", "python_flask_run_port_short"),
        ("c.PY", 2, "", "http", "code_python_flask", "dynamic", "python_flask_route"),
        ("d.js", 1, "", "http", "code_node_express", "dynamic", "node_dynamic_port"),
        ("d.js", 1, "", "unknown", "dynamic_env", "dynamic", "node_env_port"),
    }
    assert {r.source for r in S.scan_ports(df, dynamic=False).collect()} == {"config_yaml", "config_env", "code_python_flask", "code_node_express"}


def test_routes_of_two_frameworks_count_twice(spark):
    df = files(spark, [("a.py", "@app.get('/a')\n@app.route('/b', methods=['PUT', \"PATCH\"])\n@app.route('/c', methods = ['PUT'])"), ("a.rb", "@app.get('/a')")])
    got = sorted(tuple(r) for r in S.scan_routes(df).collect())
    assert got == [("a.py", 1, "/a", "GET")] * 2 + [("a.py", 2, "/b", "PATCH"), ("a.py", 2, "/b", "PUT"), ("a.py", 3, "/c", "GET"), ("a.py", 3, "/c", "POST")]


def test_components_and_their_ports(spark):
    rows = [
        ("a.yml", "server:\n  ssl: on\n  port: 9001\nx: scalar"),
        ("b.yml", "other:\n  port: 9\nport: 9002 # p\nx: scalar"),
        ("c.properties", "#server.port=1\nserver.port=99999\nport: 9003\nx=scalar"),
        ("d.json", '{"ports": {"api": 9004}, "x": "scalar"}'),
        ("e.json", '{"port": 0, "x": "scalar"}'),
        ("f.js", "ROUTER.get('/x', f)"),
        ("g.java", "class MyFilter extends A"),
        ("h.txt", "scalar"),
    ]
    got = {(r.path, r.port, r.component_type, r.name) for r in S.scan_components(files(spark, rows)).collect()}
    tool = "swagger_config"
    assert got == {
        ("a.yml", 9001, tool, tool), ("b.yml", 9002, tool, tool), ("c.properties", 9003, tool, tool), ("d.json", 9004, tool, tool), ("e.json", 8080, tool, tool),
        ("f.js", 8080, "route_handler", "/x"), ("g.java", 8080, "filter", "MyFilter"),
    }


def test_entry_points_take_the_language_of_the_project(spark):
    df = spark.createDataFrame([("p", "a.py", "@x\n@y\npublic int f(int a)\ndef g():"), ("p", "b.java", ""), ("q", "c.py", "def g():\n  pass"), (None, "d.js", "exports.h = 1")], "project string, path string, content string")
    got = {(r.path, r.line, r.name, r.kind, r.access, tuple(r.annotations)) for r in S.entry_points(df, project="project").collect()}
    assert got == {("a.py", 3, "f", "public_method", "public", ("@x", "@y")), ("c.py", 1, "g", "function", "package", ()), ("d.js", 1, "unknown", "exported", "package", ())}
    alone = {(r.path, r.line) for r in S.entry_points(df).collect()}
    assert alone == {("a.py", 4), ("c.py", 1), ("d.js", 1)}


def test_methods_after_a_commented_definition(spark):
    df = files(spark, [("a", "// def f():\n//  x\n\ny\n  def g():\ndef h():"), ("b", "def g():\n// note\ndef h():"), ("c", None)])
    assert [tuple(r) for r in S.commented_methods(df).collect()] == [("a", 5)]

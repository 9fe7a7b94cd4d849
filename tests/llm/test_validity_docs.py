from kestrel.llm import docs, validity

FILES = "file_id bigint, repo string, path string, language string, text string, extra string"


def _files(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], FILES)


def test_validity(spark):
    f = _files(
        spark,
        [
            (1, "r", "a.py", "python", "x = 1\n"), (1, "r", "a.py", "python", "x = 1\n"), (2, "r", "b.py", "python", "x = (\n"), (2, "r", "b.py", "python", "x = (\n"),
            (3, "r", "c.js", "javascript", None), (4, "r", "d.js", "javascript", ""), (5, "r", "e.txt", "text", "x = ("), (6, None, None, None, "("), (7, "s", "f.go", "go", "package a\r\n\r\nfunc f() {\r\n}\r\n"),
            (8, "s", "g.rs", "rust", "fn f() {\n" + "    let x = 1;\n" * 20000),
        ],
    )
    assert sorted(r.file_id for r in validity.invalid_files(f).collect()) == [2, 8]
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid, r.invalid_rate) for r in validity.error_rates(f).collect()}
    assert rates == {("r", "python"): (2, 1, 0.5), ("r", "javascript"): (2, 0, 0.0), ("s", "go"): (1, 0, 0.0), ("s", "rust"): (1, 1, 1.0)}
    chunks = spark.createDataFrame([("r", "b.py", "window"), ("r", "b.py", "members")], "repo string, path string, kind string")
    e = {r.file_id: r for r in validity.file_errors(f, chunks).collect()}
    assert e[2].chunk_kinds == "members,window" and e[2].first_line == 1 and e[8].chunk_kinds == ""
    assert validity.invalid_files(f.where("false")).count() == 0


def test_says_something():
    say = docs.says_something
    for d in ("", "TODO", "FIXME", "N/A", "-", "...", "-----", "Docs pending.", "TODO: document this", "@return", "@param a\n@returns", ":param x:\n:return:", "Sweep queued chargeback.", "The sweep of queued chargebacks", "nolint:all", "This function: sweep queued chargeback"):
        assert not say(d, "sweepQueuedChargeback"), d
    for d in ("Sums up every tier.", "TODO: more\nReturns the tier.", "@param a the tier to sweep from", "Liefert den Wert.", "@return the tier"):
        assert say(d, "sweepQueuedChargeback"), d


def test_functions():
    one = lambda t, g: [(f[0], f[2], f[5]) for f in docs.functions_of(t, g)]
    assert one('class A:\n    @d\n    def f(self):\n        """Adds the tax."""\n        def g():\n            r\'\'\'Inner one here.\'\'\'\n\ndef h():\n    f"""No doc {1}."""\n\ndef k(): "Says hello."\n', "python") == [("f", 3, "Adds the tax."), ("g", 5, "Inner one here."), ("k", 11, "Says hello.")]
    js = "/** Adds the tax. */\nexport async function f() {}\n\n/** Not attached. */\n\n// ----\nfunction g() {}\n/* plain */\nfunction h() {}\nclass A {\n  /**\n   * Removes a row.\n   */\n  m() {}\n}\n/** Arrow. */\nconst k = () => 1;\nconst s = '/** Fake. */ function z() {}';\n"
    assert one(js, "javascript") == [("f", 2, "Adds the tax."), ("m", 14, "Removes a row.")]
    go = "package a\n\n// F adds the tax\n// for all.\nfunc F() {}\n\n// apart\n\nfunc G() {}\nvar x = 1 // trailing words\nfunc H() {}\n"
    assert one(go, "go") == [("F", 5, "F adds the tax\n for all.")]
    rust = "/// Adds the tax.\n#[inline]\npub fn f() {}\n#[inline]\n/// Removes a row.\nfn g() {}\n// plain\nfn h() {}\n"
    assert one(rust, "rust") == [("f", 3, "Adds the tax."), ("g", 6, "Removes a row.")]
    java = "class A {\n  /** Adds the tax. */\n  @Override\n  public int f() { return 1; }\n  @Deprecated\n  /** Removes a row. */\n  void g() {}\n}\n"
    assert one(java, "java") == [("f", 4, "Adds the tax."), ("g", 7, "Removes a row.")]
    assert one("def f(:\n    'Adds a row.'\n", "python") == [] and one(None, "python") == [] and one("x", "text") == []
    assert [f[6] for f in docs.functions_of("x = 1\ndef f():\n    'Adds a row.'\n\n\ny = 2\n", "python")] == ["def f():\n    'Adds a row.'"]


def test_pairs(spark):
    f = _files(spark, [(1, "r", "a.py", "python", "def f():\n    'Adds a row.'\n")] * 2 + [(2, "r", "b.py", "python", None)])
    assert [tuple(r) for r in docs.documented_lines(f).collect()] == [(1, 1)]
    p = docs.function_pairs(f).collect()
    assert len(p) == 1 and p[0].doc == "Adds a row."
    chunks = spark.createDataFrame([("r", "a.py", "f", 1, "function_definition")], "repo string, path string, name string, start_line int, kind string")
    assert [tuple(r) for r in docs.pair_statistics(f, chunks).collect()] == [("python", "function_definition", "function_definition", 1, 11.0)]

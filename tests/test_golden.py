"""Hand-written rows for the traps of the inventory."""
from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions import names as N
from docatlas.functions import text as T
from docatlas.operators import calls as K
from docatlas.operators import candidates as C
from docatlas.operators import evidence as E
from docatlas.operators import logs as G
from docatlas.operators import lookups as L
from docatlas.operators import pages as P
from docatlas.operators import records as R
from docatlas.operators import resolve as X
from docatlas.operators import symbols as S


def values(spark, items, expr):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def page(spark, html, url="https://learn.microsoft.com/en-us/windows/win32/api/x/nf-x-y"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def facts(spark, html, *names):
    return P.page_facts(page(spark, html), *names).first()


def test_dimension_sizes():
    assert len(dims.keyword_rules()) == 489
    assert len({o for o, *_ in dims.header_rules()}) == 467
    assert len({d for d, _, _ in dims.module_headers()}) == 30


def test_symbol_kinds(spark):
    names = ["CreateProcessW", "TOKEN_INFO", "IUnknown", "NtClose", "ReadFile", "peb", "GUID", "CreateHook"]
    assert values(spark, names, N.symbol_kind) == [
        "callback", "structure", "com_interface", "native_function", "win32_function", "structure", "enum", "callback"]


def test_validation(spark):
    df = spark.createDataFrame([("a b",), ("a-b",), ("",), (None,), ("x\n",)], "symbol string")
    ok, bad = S.read_symbols(df)
    assert [r.symbol for r in ok.collect()] == ["a-b"]
    assert sorted((r.symbol or "", r.reason) for r in bad.collect()) == [
        ("", "empty"), ("", "empty"), ("a b", "characters"), ("x\n", "characters")]


def test_modules(spark):
    names = ["CreateProcessAsUserW", "LdrUnknownX", "NtCreateProcessEx", "CreateWindowStation", "EnumServicesX", "Foo", "OpenKeyX"]
    assert values(spark, names, N.module_of) == [
        "advapi32.dll", "ntdll.dll", "ntdll.dll", "user32.dll", "advapi32.dll", None, "advapi32.dll"]


#: Written down by hand from the documented behaviour, not read from the tables.
KEYWORD_GOLDEN = {
    "GetFileVersionInfo": "kernel32.dll", "GetFileVersioInfoA": "version.dll", "VerQueryValueW": "version.dll", "CreateProcessAsUserW": "advapi32.dll",
    "CreateProcessW": "kernel32.dll", "NtClose": "ntdll.dll", "ZwFoo": "ntdll.dll", "RegOpenKeyExW": "advapi32.dll", "MessageBoxA": "user32.dll",
    "BitBlt": "gdi32.dll", "EnumProcesses": "psapi.dll", "WSAStartup": "ws2_32.dll", "InternetOpenA": "wininet.dll", "URLDownloadToFileW": "urlmon.dll",
    "WinHttpOpen": "winhttp.dll", "Process32First": "kernel32.dll", "FtpPutFileA": "wininet.dll", "ShellExecuteW": "shell32.dll",
    "CertOpenStore": "crypt32.dll", "ImageList_Create": "comctl32.dll", "memcpy": "msvcrt.dll", "PlaySoundW": "winmm.dll", "MapAndLoad": "imagehlp.dll",
    "SetupDiGetClassDevsW": "setupapi.dll", "NtUnmapViewOfSection": "ntdll.dll", "VirtualAllocEx": "kernel32.dll", "CryptAcquireContextW": "advapi32.dll",
}
HEADER_GOLDEN = {
    "NtCreateFile": ["winternl", "ntddk", "wdm", "ntifs", "fileapi"],
    "FindClose": ["fileapi", "wingdi"],  # "dc" is inside
    "BitBlt": ["wingdi"],
    "Process32First": ["processthreadsapi", "tlhelp32"],
    "URLDownloadToFileW": ["fileapi", "urlmon"],
    "HeapAlloc": ["heapapi", "memoryapi"],
    "RegOpenKeyExW": ["winreg"],
}


def test_keyword_and_header_rows(spark):
    assert values(spark, list(KEYWORD_GOLDEN), N.module_of) == list(KEYWORD_GOLDEN.values())
    got = values(spark, list(HEADER_GOLDEN), lambda c: F.array_distinct(F.flatten(F.transform(N.rule_headers(c), lambda r: r["headers"]))))
    assert [list(g) for g in got] == list(HEADER_GOLDEN.values())


def test_every_rule_is_emitted(spark):
    """A name matched by an exact rule and by general ones gets a row for each of them."""
    got = values(spark, ["CreateFileW"], lambda c: F.transform(N.rule_headers(c), lambda r: F.concat_ws(" ", r["headers"])))[0]
    assert list(got).count("fileapi") >= 3


def test_pattern_shapes():
    assert dims.pattern_shapes("^createfilew$") == [("exact", "createfilew")]
    assert dims.pattern_shapes("^nt.*") == [("prefix", "nt")]
    assert dims.pattern_shapes("select.*") == [("prefix", "select")]
    assert dims.pattern_shapes(".*blt.*") == [("contains", "blt")]
    assert dims.pattern_shapes("^(nt|zw)openfile$") == [("exact", "ntopenfile"), ("exact", "zwopenfile")]
    assert dims.pattern_shapes("get.*dc.*") == [("regex", "get.*dc")]
    assert dims.pattern_shapes(".*processes$") == [("regex", r".*processes\z")]


def test_fallback_evidence(spark):
    def pairs(c):
        return F.transform(N.fallback_evidence(c), lambda r: F.concat_ws("=", r["header"], r["score"].cast("string")))
    assert values(spark, ["NtFoo", "Zzz", "ntfoo", "SetText"], pairs) == [
        ["winternl=0.8", "ntddk=0.7"], ["winbase=0.4"], ["winbase=0.4"], ["winuser=0.7"]]


def test_scores_add_up(spark):
    header_map = spark.createDataFrame([(0, "fileapi", "CreateFile")], "ord long, header string, function string")
    symbols = spark.createDataFrame([("CreateFileW", None)], "symbol string, dll string")
    top = E.top_headers(E.header_evidence(symbols, E.expand_map(header_map))).collect()
    assert [(r.header, r.score) for r in top] == [("fileapi", 1.85)]


def test_map_last_write_and_exact_case(spark):
    header_map = spark.createDataFrame([(0, "h1", "Foo"), (1, "h2", "foo")], "ord long, header string, function string")
    function_map = spark.createDataFrame([("Foo", "fm")], "function string, header string")
    got = {r.key: r.header for r in E.expand_map(header_map, function_map).collect()}
    assert got["foo"] == "h2" and got["Foo"] == "fm" and got["fooa"] == "h2" and got["FooW"] == "h1"


def urls(spark, name, dll=None):
    df = spark.createDataFrame([(name, dll)], "symbol string, dll string")
    return [r.url.replace("https://learn.microsoft.com/en-us/", "") for r in C.url_candidates(df).orderBy("rank").collect()]


def test_native_url_order(spark):
    got = urls(spark, "NtClose", "ntdll.dll")
    assert got[0].endswith("ntdef/nf-ntdef-ntclose") and got[9].endswith("wdm/nf-wdm-zwclose")
    assert urls(spark, "ZwClose")[0].endswith("ntdef/nf-ntdef-ntclose")
    assert urls(spark, "RtlFoo")[0].endswith("ntdef/nf-ntdef-rtlfoo")


def test_suffix_is_tested_on_lower_case(spark):
    got = urls(spark, "GetData")
    assert got[0].endswith("-getdata") and got[1].endswith("-getdat") and not any(u.endswith("getdataa") for u in got)


def test_legacy_url_in_front(spark):
    assert urls(spark, "URLDownloadToFile")[0].startswith("previous-versions/")
    assert urls(spark, "FtpPutFile")[0].endswith("wininet/nf-wininet-ftpputfilea")


def test_header_order_and_cap(spark):
    df = spark.createDataFrame([("DeleteFile", "kernel32.dll"), ("RtlMoveMemory", None), ("RtlUnwind", None)], "symbol string, dll string")
    got = {}
    for r in C.header_candidates(df).orderBy("rank").collect():
        got.setdefault(r.symbol, []).append(r.header)
    assert got["DeleteFile"][:3] == ["fileapi", "wingdi", "memoryapi"] and len(got["DeleteFile"]) == 8
    assert got["RtlMoveMemory"][:5] == ["ntddk", "wdm", "ntifs", "memoryapi", "winternl"]
    assert got["RtlUnwind"][:4] == ["ntddk", "wdm", "ntifs", "winnt"]


def test_search_hit_is_by_rank(spark):
    rows = [("Foo", 1, "https://x/windows-hardware/drivers/ddi/a", "Foo routine"), ("Foo", 2, "https://x/windows/win32/api/a", "Foo"),
            ("Bar", 1, "https://x/azure/a", "Bar"), ("Bar", 2, "https://x/other/a", "Bar"), ("Baz", 1, "https://x/other", "Baz")]
    got = {r.symbol: r.url for r in L.pick_search_hit(spark.createDataFrame(rows, "symbol string, rank long, url string, title string")).collect()}
    assert got == {"Foo": rows[0][2], "Bar": rows[2][2]}


def test_catalog_fallbacks(spark):
    cat = spark.createDataFrame([
        (0, "Foo", "structure", "u0", "en-us"), (1, "Foo", "macro", "u1", "pt-br"), (2, "BarA", "function", "u2", "pt-br"),
        (3, "BarW", "function", "u3", "en-us"), (4, "Ba", "function", "u4", "en-us")],
        "ord long, name string, type string, url string, language string")
    names = spark.createDataFrame([("foo",), ("Bar",), ("Baw",), ("Nope",)], "symbol string")
    assert {r.symbol: r.url for r in L.lookup_catalog(names, cat).collect()} == {"foo": "u1", "Bar": "u3", "Baw": "u4"}


def test_valid_page_counts_bytes(spark):
    rows = [(1, 200, "text/HTML", "é" * 1020 + " api"), (2, 200, "text/html", "é" * 1023 + " api"), (3, 200, "x", "function"),
            (4, 404, "text/html", "function"), (5, 200, "text/html", "Routine")]
    log = spark.createDataFrame(rows, "id int, status int, content_type string, body_head string")
    assert [r.id for r in X.valid_pages(log, "fast", 2048).collect()] == [1]
    assert [r.id for r in X.valid_pages(log, "slow", 1024).collect()] == [3, 5]
    assert [r.id for r in X.valid_pages(log, "fast").collect()] == [1, 2]
    assert [r.id for r in X.valid_pages(log, "slow").collect()] == [1, 2, 3, 5]


def test_limits_are_arguments(spark):
    d = spark.createDataFrame([("CreateFileW", "kernel32.dll")], "symbol string, dll string")
    every = [r.header for r in C.header_candidates(d).orderBy("rank").collect()]
    assert len(every) > 25 and [r.header for r in C.header_candidates(d, 8).orderBy("rank").collect()] == every[:8]
    urls = C.url_candidates(d).withColumn("valid", F.lit(False))
    assert C.probe_budget(urls).count() == urls.count() > 50 and C.probe_budget(urls, total=25).count() == 25
    page = urls.where("rank = 40").select(F.lit(7).cast("long").alias("page_id"), "url")
    none = {"search_results": "symbol string, rank long, url string, title string", "key_map": "key string, header string", "function_map": "function string, header string",
            "catalog": "ord long, name string, type string, header string, url string, language string, description string"}
    empty = [spark.createDataFrame([], ddl) for ddl in none.values()]
    assert X.resolve(d.select("symbol"), *empty, page).first().page_id == 7
    assert not X.resolve(d.select("symbol"), *empty, page, total=25).first().found


# ------------------------------------------------------------------ pages


def test_page_names(spark):
    def name(html):
        return facts(spark, html, "name").name
    assert name("<h1>HeapAlloc function (heapapi.h)</h1>") == "HeapAlloc (heapapi.h)"
    assert name("<h1>Função X (h.h)</h1>") == "Função X (h.h)"
    assert name("<h1>Função Ação rotina (h.h)</h1>") == "Ação (h.h)"
    assert name("<title>Sleep API docs</title>") == "Sleep"
    assert name("<p>x</p><pre>if (a) b</pre><pre>Foo (1)</pre>") == "Foo"
    assert name("<p>nothing</p>") == dims.UNKNOWN_NAME
    assert name("plain") == "Y"


def test_module_sources(spark):
    def dll(html):
        return facts(spark, html, "dll").dll
    assert dll("<h1>F</h1><p>user32.dll</p><h2>Requirements</h2><p>Library: A.dll</p>") == "A.dll"
    assert dll("<table><tr><td>Minimum</td>\n<td>b.exe</td></tr></table><p>c.dll</p>") == "b.exe"
    assert dll("<p>see c.dll</p>") == "c.dll"
    assert dll("<p>none</p>") == "kernel32.dll"


PARAMS = """<div><h1>F function (f.h)</h1><h2>Syntax</h2><pre>BOOL F([in] const MSG *lpMsg, HWND hPoint2);</pre><h2>Parameters</h2>
<p><code>[in] lpMsg</code></p><p>(short)</p><p>The first long description.</p><p><code>(a+b)</code></p><hr><p>Continued description text.</p>
<p><code>hPoint</code></p><p>Second long description.</p><h3>More</h3><p>Third long description.</p><h2>Remarks</h2><p>Not a parameter text.</p></div>"""


def test_parameters(spark):
    got = facts(spark, PARAMS, "parameters").parameters
    assert [(p.name, p.type, p.description) for p in got] == [
        ("lpMsg", "const MSG*", "The first long description. Continued description text."),
        ("hPoint", "INT", "Second long description. Third long description.")]


def test_return_type(spark):
    def kind(sig):
        return facts(spark, f"<h2>Syntax</h2><pre>{sig}</pre>", "return_type").return_type
    assert kind("HANDLE F(int a);") == "HANDLE" and kind("FOO F(int a);") == "BOOL"


def test_architectures(spark):
    def arch(text):
        return facts(spark, f"<p>{text}</p><script>x64</script>", "architectures").architectures
    assert arch("none") == ["x86", "x64"] and arch("desktop only") == ["x86"] and arch("32-bit and x64") == ["x64", "x86"]


def test_return_table_with_id_is_dropped_for_parameters(spark):
    html = ("<h2>Parameters</h2><p><code>[in] uType</code></p><p>The type of the box here.</p><table><tr><th>Value</th><th>Meaning</th></tr>"
            "<tr><td>{}</td><td>text</td></tr></table>")
    assert facts(spark, html.format("INVALID_HANDLE"), "parameters").parameters[0]["values"] is None
    assert facts(spark, html.format("MB_OK"), "parameters").parameters[0]["values"][0].title == "Parameters"


def test_table_scope_ends_at_next_bracketed_parameter(spark):
    table = "<table><tr><th>Value</th><th>Meaning</th></tr><tr><td>{}</td><td>text</td></tr></table>"
    html = ("<h2>Parameters</h2><p><code>[in] uType</code></p><p>The type of the box here.</p>" + table.format("AAA 1") +
            "<p><code>[in] dwShareMode</code></p><p>The share mode to be used.</p>" + table.format("BBB 2") + "<h2>Other</h2>" + table.format("CCC 3"))
    got = facts(spark, html, "parameters").parameters
    assert [[e.value for t in p["values"] for e in t.entries] for p in got] == [["AAA (1)"], ["BBB (2)", "CCC (3)"]]


def test_description_enters_notes_and_stops(spark):
    html = ("<div><h1>F</h1><p>Short description.</p><p>See also: x</p><section><p>Inner text.</p><p>Inner text.</p></section><h2>Remarks</h2>"
            "<p>Remark paragraph.</p><h2>Parameters</h2><p>Never part of it.</p></div>")
    assert facts(spark, html, "description").description == "Short description. Inner text. Remark paragraph."


def test_description_keeps_all_or_the_first(spark):
    html = "<h1>F</h1>" + "".join(f"<p>Paragraph {i} text.</p>" for i in range(30)) + "<h2>Note</h2><p>A longer note text.</p>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    whole, ten = P.page_facts(pages, "description").first().description, P.page_facts(pages, "description", paragraphs=10).first().description
    assert whole.count("Paragraph") == 30 and whole.endswith("note text.")
    assert ten.count("Paragraph") == 10 and "Paragraph 9 " in ten and "note" not in ten


def test_language_of_any_container(spark):
    def language(html):
        return facts(spark, html, "signature_language").signature_language

    code = "<pre>BOOL f(DWORD x);</pre>"
    page = "<h1>F</h1><div class='{}'><div class='{}'><section><h2>Syntax</h2>" + code + "</section></div></div>"
    assert language(page.format("lang-csharp", "x")) == "csharp"
    assert language(page.format("lang-csharp", "language-js")) == "js"
    assert language(page.format("y", "x")) == "cpp"
    closed = "<h1>F</h1><div class='lang-csharp'><div class='lang-js'>z</div><p>a</p></div><div><h2>Syntax</h2>" + code + "</div>"
    assert language(closed) == "cpp"
    assert language(closed.replace("<div><h2>", "<div class='a lang-vb'><div class='lang-js'>q</div><h2>")) == "vb"


def test_members_of_code_elements(spark):
    text = "typedef struct { DWORD cb;\n LPVOID p; } T;".replace("{ ", "{\n")
    for tag in ("pre", "code", "pre><code"):
        end = "</code></pre>" if ">" in tag else f"</{tag}>"
        pages = spark.createDataFrame([(1, "u", f"<h1>T structure</h1><p>Text <code>x</code> and <{tag}>{text}{end}</p>")], "page_id long, url string, html string")
        d = P.page_facts(pages, "members", "definition").first()
        assert [m["name"] for m in d.members] == ["cb", "p"] and "typedef" in d.definition


def test_pages_of_one_id_stay_apart(spark):
    rows = [(1, "u1", "<h1>A function (a.h)</h1>"), (1, "u2", "<h1>B function (b.h)</h1>"), (1, "u2", "<h1>B function (b.h)</h1>"), (2, "u1", "<h1>A function (a.h)</h1>"), (None, None, "<h1>C</h1>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.url, r.name) for r in P.page_facts(pages, "url", "name").collect()), key=str)
    assert got == [(1, "u1", "A (a.h)"), (1, "u2", "B (b.h)"), (2, "u1", "A (a.h)"), (None, None, "C")]


def test_remarks_take_nested_text_and_lists(spark):
    html = "<div><h2>Remarks</h2><div><p>Nested one.</p><p>Nested two.</p></div><ul><li>item text one</li></ul><p>tiny</p></div><p>After the page part.</p>"
    assert facts(spark, html, "remarks").remarks == "Nested one.Nested two.\n\nitem text one"


def test_broken_html(spark):
    html = "<h1>F function (f.h)</h1></div></div><p>Unclosed <b>bold<p>Next paragraph here.<h2>Remarks<p>Lost heading end"
    got = facts(spark, html, "name", "description")
    assert got.name == "F (f.h)" and got.description.startswith("Unclosed bold Next paragraph here.")


def test_entities(spark):
    got = facts(spark, "<h1>A &#38; B &lt;x&gt; &#x41;&eacute;</h1>", "name").name
    assert got == "A & B <x> A&eacute;"


def test_signature_layout(spark):
    df = spark.createDataFrame([("WINAPI\n\nint F(\n\t  int a,\n      int b\n    );  ",), ("x",)], "s string")
    got = [r.out for r in T.with_signature(df, F.col("s"), "out").collect()]
    assert got == ["WINAPI int F(\nint a,\n   int b\n );  ", "x"]


def test_member_code(spark):
    html = "<h1>X_Y</h1><pre>typedef struct _A {\n  /* c */\n  // d\n  ULONG *Ptr; // e\n  BYTE Reserved[2];\n  int n;\n} A;</pre><p>The Ptr points to the data.</p>"
    got = facts(spark, html, "members").members
    assert [(m.name, m.type, m.description) for m in got] == [
        ("Ptr", "ULONG *", "The Ptr points to the data."), ("Reserved", "BYTE[2]", "Campo reservado para uso interno do sistema"),
        ("n", "int", "The Ptr points to the data.")]


def test_memcpy_record_and_not_found(spark):
    names = spark.createDataFrame([("MemCpy",), ("Zap",)], "symbol string")
    rec = R.memcpy_record(names).first()
    assert rec.symbol == "MemCpy" and rec.parameter_count == 3 and rec.parameters[2].type == "size_t"
    gone = R.not_found_records(names.filter("symbol = 'Zap'"), "br").first()
    assert gone.fallback_used and gone.error.startswith("Função 'Zap'") and gone.url is None


# ------------------------------------------------------------------ calls and logs


def test_argument_types(spark):
    tokens = ["-5", "5", "2147483648", "-2147483649", "0x10", "010", '"5"', "$b:0", "$s:hi", "1_000", "0b11", "0o17", "18446744073709551615", "0xG", "00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    got = [(r.kind, r.width, None if r.number is None else int(r.number), r.text) for r in K.typed(df, "t").orderBy("i").collect()]
    assert got == [("int", "i32", -5, None), ("int", "u32", 5, None), ("int", "u64", 2147483648, None), ("int", "i64", -2147483649, None),
                   ("int", "u32", 16, None), ("wstr", None, None, "010"), ("wstr", None, None, "5"), ("error", None, None, None),
                   ("str", None, None, "hi"), ("int", "u32", 1000, None), ("int", "u32", 3, None), ("int", "u32", 15, None),
                   ("int", "u64", 18446744073709551615, None), ("wstr", None, None, "0xG"), ("int", "u32", 0, None)]


def test_options(spark):
    df = spark.createDataFrame([("a --ret --wide b --ret i32",), ("x --ret",), ("--ret foo --wide --show-error y",)], "args string")
    got = [(r.arguments, r.return_type, r.wide, r.option_error) for r in K.parse_options(df).collect()]
    assert got == [(["a", "b"], "i32", False, None), (["x"], "u32", False, "missing return type"), (["y"], "foo", True, "unknown return type")]


def test_hexdump(spark):
    df = spark.createDataFrame([(bytearray(b"ABCDEFGHIJKLMNO\x00Z"),), (bytearray(b""),)], "d binary")
    got = sorted(r.line for r in K.hexdump(df, "d").collect())
    assert got == ["(empty)", "00000000  41 42 43 44 45 46 47 48 49 4a 4b 4c 4d 4e 4f 00  ABCDEFGHIJKLMNO.",
                   "00000010  5a" + " " * 45 + "  Z"] or got[0] == "(empty)" and len(got) == 3 and got[2].endswith("  Z")


def test_health_states():
    h, seen = G.Health(), []
    for i in range(100):
        seen += h.step(float(i) / 1000, 500)
    assert seen == ["OPEN"] and h.step(0.5, 200) == []
    assert h.step(2.1, 200) == ["HALF_OPEN", "CLOSED"] and h.count == 0 and h.needed == 2


def test_retry_delays(spark):
    got = spark.createDataFrame([(1,), (2,), (9,)], "n int").select(F.round(G.retry_delay(F.col("n")), 6)).collect()
    assert [r[0] for r in got] == [0.1, 0.15, 2.0]


def test_title_parts(spark):
    s, h = R.title_parts("x")
    df = spark.createDataFrame([("Função Foo (a.h) extra",), ("Structure Bar",)], "x string")
    assert [tuple(r) for r in df.select(s, h).collect()] == [("Foo", "a.h"), ("Bar", None)]


def test_labels(spark):
    df = spark.createDataFrame([("br", "members"), ("us", "members"), ("fr", "dll"), ("us", "nope")], "lang string, key string")
    got = {(r.lang, r.key): r.label for r in L.localise(df, "lang", "key", dims.RECORD_LABELS).collect()}
    assert got == {("br", "members"): "Membros", ("us", "members"): "members", ("fr", "dll"): "DLL", ("us", "nope"): "nope"}

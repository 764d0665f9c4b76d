"""Symbols, function bodies, structure chunks and routes on code that the template files do not hold."""

from riskloom.operators import chunk, java, symbols

FILES = "project string, path string, content string, size long"


def one(spark, path, text):
    return spark.createDataFrame([("p", path, text, len(text))], FILES)


def test_java_symbols(spark):
    text = """package a.b;
/* class Ghost { */
// public class Shadow {
public abstract class Shop<T> extends Base<T> implements One, Two<String> {
    private static final String URL = "http://x/{y}"; // class Not {
    public Map<String, Integer> sell(@Valid final Item item,
                                     List<Map<String, Integer>> rest) {
        return null;
    }
}
interface Small extends Left, Right {
}
"""
    got = {(r.kind, r.name): r for r in symbols.symbols(one(spark, "Shop.java", text)).collect()}
    shop = got["class", "Shop"]
    assert (shop.line, shop.end_line, shop.supers, shop.package) == (4, 10, ["Base", "One", "Two"], "a.b") and shop.modifiers == ["public", "abstract"]
    assert got["class", "Small"].supers == ["Left", "Right"] and ("class", "Ghost") not in got and ("class", "Shadow") not in got
    assert got["field", "URL"].owner == "Shop" and got["field", "URL"].modifiers == ["private", "static", "final"]


def test_python_and_js_symbols(spark):
    text = """class A(Base, metaclass=M):
    limit: int = 3
    async def go(self, a: int, *rest, b=(1, 2)):
        return a
    # def gone(self):

def after(x):
    pass
"""
    got = {(r.kind, r.name): r for r in symbols.symbols(one(spark, "a.py", text)).collect()}
    assert got["class", "A"].supers == ["Base"] and (got["class", "A"].line, got["class", "A"].end_line) == (1, 4 + 1)
    assert [(p.name, p.type) for p in got["method", "go"].params] == [("a", "int"), ("rest", "any"), ("b", "any")]
    assert ("method", "gone") not in got and got["field", "limit"].line == 2 and got["method", "after"].owner == "A"
    js = symbols.symbols(one(spark, "a.js", "export default class B extends C {\n  run(x, y) {\n  }\n  size: 3\n}\n")).collect()
    assert sorted((r.kind, r.name, r.line, r.end_line) for r in js) == [("class", "B", 1, 5), ("field", "size", 4, None), ("method", "run", 2, None)]


def test_function_calls_are_those_of_the_body(spark):
    many = "\n".join(f"  step{i}();" for i in range(150))
    text = "function first({a, b} = {}) {\n" + many + "\n  log('} skip(');\n}\nconst second = (x) => third(x);\nfunction third(x) { return x }\n"
    got = {r.name: r.calls for r in symbols.function_index(one(spark, "a.js", text)).collect()}
    assert got == {"first": [f"step{i}" for i in range(150)] + ["log"], "second": ["third"], "third": []}
    py = {r.name: r.calls for r in symbols.function_index(one(spark, "a.py", "def a(x):\n    b(x)\n\n    c()\nd()\ndef e(): f()\n")).collect()}
    assert py == {"a": ["b", "c"], "e": ["f"]}


def test_structure_chunks(spark):
    text = "import x\nfunction a()\n{\n  if (b) { c }\n}\nlet z = 1\nclass D {\n  m() {\n  }\n}\nfunction e() { return 1 }\n"
    got = [(r.chunk_type, r.name, r.line_start, r.line_end) for r in chunk.chunk_structure(one(spark, "a.js", text)).orderBy("chunk_no").collect()]
    assert got == [("function", "a", 2, 5), ("class", "D", 7, 10), ("function", "e", 11, 11)]
    py = chunk.chunk_structure(one(spark, "a.py", "@x\ndef a():\n    pass\nclass B:\n    y = 1\n    def c(self):\n        pass\n")).collect()
    assert [(r.chunk_type, r.name, r.line_start, r.line_end) for r in py] == [("function", "a", 2, 3), ("class", "B", 4, 5), ("function", "c", 6, 8)]


def test_routes(spark):
    text = """@RestController
@RequestMapping(value = "/api/")
public class A {
    @GetMapping({"one", "/two"})
    @PreAuthorize("hasRole('X') and f(1)")
    List<Item> list(@RequestParam("q") String q, @RequestBody Item first, @RequestBody Item second) { }
    /* @GetMapping("/gone") */
    @RequestMapping(value = "/three", method = {RequestMethod.PUT, RequestMethod.POST})
    public String put() { }
}
@Path("res")
class B {
    @DELETE
    public void drop() { }
}
"""
    got = {(r.framework, r.http_method, r.url_path, r.line, r.class_name, r.method_name) for r in java.extract_routes(one(spark, "A.java", text)).collect()}
    assert got == {("Spring MVC", "GET", "/api/one", 4, "A", "list"), ("Spring MVC", "GET", "/api/two", 4, "A", "list"), ("Spring MVC", "PUT", "/api/three", 8, "A", "put"),
                   ("Spring MVC", "POST", "/api/three", 8, "A", "put"), ("JAX-RS", "DELETE", "res/", 13, "B", "drop")}
    assert java.extract_routes(one(spark, "A.java", text)).first().body_params == ["first", "second"]
    xml = """<struts><package name="a" namespace="/a"><action class="x.Y" name="go"/></package>
<!-- <action name="no" class="z"> -->
<package namespace="/b"><action name="run" class="x.Z" method="m"></action></package></struts>"""
    assert {(r.url_path, r.line, r.class_name, r.method_name) for r in java.extract_routes(one(spark, "conf/struts-web.xml", xml)).collect()} == {
        ("/a/go.action", 1, "x.Y", "execute"), ("/b/run.action", 3, "x.Z", "m")}

"""Definitions of brace languages: strings, comments, templates and nested scopes; hostile texts in linear time."""

import time

import pytest

from annalist.functions import code, scanner

JS = r'''// class No {
import x from "y";
/* function nope() { */
export default class Server extends Base {
  count = 0;
  handle = async (req) => {
    return `a ${ req.map(x => { return `}` + x; }) } function no() {`;
  };
  #secret() { return /[}{/]"/.test(this.x); }
  constructor(a, { b } = {}) { super(a); if (a) { this.go(); } }
  static async *gen<T>(x: T): AsyncGenerator<T> {
    yield x;
  }
  get size(): { a: number } {
    return 1;
  }
  plain() {
    const s = "}}}{"; for (const x of y) { run(x); }
  }
}
export const add = (a, b) => a + b;
const later = async function () {
  return 1;
};
let n = 3;
export async function main(a: string, b: () => void): Promise<void> {
  doIt(function inner() { return 2; });
}
interface Shape { area(): number; }
type Alias = | "a"
  | "b";
enum Kind { A, B }
abstract class P { protected abstract run(x: number): void; private x; }
'''
JS_HAS = [
    ("Server", "class", 4, 20),
    ("Server::handle", "method", 6, 8),
    ("Server::secret", "method", 9, 9),
    ("Server::constructor", "method", 10, 10),
    ("Server::gen", "method", 11, 13),
    ("Server::size", "method", 14, 16),
    ("Server::plain", "method", 17, 19),
    ("add", "function", 21, 21),
    ("later", "function", 22, 24),
    ("main", "function", 26, 28),
    ("main::inner", "method", 27, 27),
    ("Shape", "class", 29, 29),
    ("Alias", "class", 30, 31),
    ("Kind", "class", 32, 32),
    ("P", "class", 33, 33),
    ("P::run", "method", 33, 33),
]

GO = r'''package x
// func no() {
type Server struct {
	a int
}
type ID int
type (
	A struct { x int }
	B = string
)
func (s *Server) Run(ctx context.Context, f func() interface{}) (int, error) {
	x := `}}} func no() {`
	c := '}'
	return func() int { return 1 }(), nil
}
func Map[T any, U any](xs []T) interface{} {
	return nil
}
type List[T any] struct { next *List[T] }
type I interface {
	Do()
}
'''
GO_HAS = [
    ("Server", "class", 3, 5),
    ("ID", "class", 6, 6),
    ("A", "class", 8, 8),
    ("B", "class", 9, 9),
    ("Server::Run", "method", 11, 15),
    ("Map", "function", 16, 18),
    ("List", "class", 19, 19),
    ("I", "class", 20, 22),
]

RS = r'''/* outer /* fn no() { */ still } */
pub struct Point<'a> { x: &'a str }
pub(crate) struct Unit;
struct Tup(u8, u8);
enum E { A { x: i32 }, B }
pub trait Draw { fn draw(&self); fn twice(&self) { self.draw(); } type Out; }
impl<'a> Draw for Point<'a> {
    type Out = u8;
    fn draw(&self) { let c = '}'; let s = r#"}" fn no() {"#; let t = "a
}"; }
}
impl<T: Clone> geo::Shape<T> { pub async unsafe fn area(&self) -> f64 where T: Copy { 1.0 } }
pub type Alias = Vec<u8>;
fn main() {
    let f = |x| { x };
}
'''
RS_HAS = [
    ("Point", "class", 2, 2),
    ("Unit", "class", 3, 3),
    ("Tup", "class", 4, 4),
    ("E", "class", 5, 5),
    ("Draw", "class", 6, 6),
    ("Draw::draw", "method", 6, 6),
    ("Draw::twice", "method", 6, 6),
    ("Point::draw", "method", 9, 10),
    ("Shape::area", "method", 12, 12),
    ("Alias", "class", 13, 13),
    ("main", "function", 14, 16),
]

JAVA = r'''package a;
/** class No { */
@Anno(x = "}")
public final class Box<T extends Comparable<T>> implements I<T> {
    private Map<String, List<T>> m = new HashMap<>();
    static { init(); }
    Box(int a) { this.a = a; }
    @Override
    public String toString() { return """
      } class Not {
      """; }
    public static <K, V> Map<K, V> of(K k, V v) throws E, F {
        if (k == null) { throw new X(k); }
        return new A() { void inner() { } };
    }
    abstract void later(int x);
    protected native int nat(char c);
    int plain() {
        char c = '{';
        return c;
    }
    enum Color { RED, GREEN; Color next() { return RED; } }
    record P(int x, int y) { }
}
interface I<T> { void f(); default int g() { return 1; } }
'''
JAVA_HAS = [
    ("Box", "class", 4, 24),
    ("Box::Box", "method", 7, 7),
    ("Box::toString", "method", 9, 11),
    ("Box::of", "method", 12, 15),
    ("Box::later", "method", 16, 16),
    ("Box::nat", "method", 17, 17),
    ("Box::plain", "method", 18, 21),
    ("Box::Color", "class", 22, 22),
    ("Box::Color::next", "method", 22, 22),
    ("Box::P", "class", 23, 23),
    ("I", "class", 25, 25),
    ("I::g", "method", 25, 25),
]


@pytest.mark.parametrize("path, text, want", [("a.ts", JS, JS_HAS), ("a.go", GO, GO_HAS), ("a.rs", RS, RS_HAS), ("A.java", JAVA, JAVA_HAS)])
def test_definitions(path, text, want):
    assert [(s[0].split("::", 1)[1], *s[2:]) for s in code.symbols_of(text, path)] == want
    assert all(s[1] == s[0].rsplit("::", 1)[1] for s in code.symbols_of(text, path))


def test_text_without_definitions():
    for path in ("a.md", "a.json", "b/c.yml"):
        assert code.symbols_of("class of its own\nfunction f() {}\n", path) == []
    assert code.symbols_of("", "a.ts") == code.symbols_of(None, "a.ts") == []
    broken = code.symbols_of("class A(:\n    def f(self):\n        x\n", "a.py")  # does not parse
    assert [s[0] for s in broken] == ["a.py::A", "a.py::A::f"]


@pytest.mark.parametrize("language", ["js", "go", "rust", "java"])
def test_what_is_no_code(language):
    text = "a /* { // */ b // { '\nc \"{ // }\" d '}' e"
    bare = scanner.blanked(text, language)
    assert len(bare) == len(text) and bare.split() == list("abcde") and bare.count("\n") == 1


def test_templates_and_expressions():
    text = "x = `a ${ f({b: `c ${ d }`}) } } e`; y = g / 2 / h; z = /[/}]{/.test(i)"
    assert scanner.blanked(text, "js").split() == ["x", "=", "f({b:", "d", "})", ";", "y", "=", "g", "/", "2", "/", "h;", "z", "=", ".test(i)"]
    assert scanner.blanked("let a = 'x'; fn f<'a>(b: &'a str) { r#\"}\"#; }", "rust").split() == "let a = ; fn f< a>(b: & a str) { ; }".split()


@pytest.mark.parametrize("piece", ["f(", "a<", "type a ", "class a{", "${", "x = a / b; ", "static f(){", "impl<", "func (", "'{"])
def test_hostile_texts(piece):
    for language in ("js", "go", "rust", "java"):
        began = time.process_time()
        scanner.definitions(piece * (40_000 // len(piece)), "x", language)
        assert time.process_time() - began < 10

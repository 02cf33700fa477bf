"""Source files whose definitions were marked by hand, as a table for queries and tests.

``«name:kind»`` stands where a definition begins and ``¦`` where it ends; a definition without a name has none before the colon.
"""

from __future__ import annotations

import re

FILES = {
    "src/plain.py": """import os

«alpha:function»def alpha():
    return 1¦  # TODO one

«beta:function»async def beta(x,
               y={}):
    # TODO: inside beta
    return alpha()¦

@decorated
«Box:class»class Box:
    \"\"\"A box. TODO\"\"\"

    «open_lid:function»def open_lid(self):
        «inner:function»def inner():
            return "}"¦  # TODO ünï
        return beta()¦

    size = 1¦
TODO = 3
""",
    "src/broken.py": """print 'TODO: not of this version'
«gamma:function»def gamma(a, b):
    text = '''
def no():
'''
    return a¦  # TODO

«Crate:class»class Crate(object):
    «open_lid:function»def open_lid(self):

        exec "x"¦  # TODO

    «weigh:function»def weigh(self): return 2¦¦
x = 1
""",
    "src/lib.rs": """//! TODO at the top
«one:function»fn one(x: [u8; 4]) -> u8 { x[0] /* TODO } */ }¦
«Lid:class»struct Lid { n: i32 }¦
pub «Pair:class»struct Pair(i32, [u8; 3]);¦
«Shape:class»enum Shape { Round, Flat(i32) }¦
«:block»impl<T: Fn(i32) -> i32> Lid<T> where T: Clone {
    pub «openLid:function»fn openLid(&self) -> Vec<[u8; 4]> where T: Sized {
        let s = "}"; // TODO later { not a brace
        self.n
    }¦
}¦
«inner:module»mod inner {
    «deep:function»fn deep() { let r = r#"}"#; todo(); }¦ // TODO
}¦
""",
    "web/a.js": """«F:function»function F({a, b}) {
  return a; // TODO
}¦
«h:function»const h = (o = {}) => {
  return o; // TODO
}¦;
«k:function»const k = async (cb, x = (1)) => cb(x);¦
«p:function»let p = function (a) { return a; /* TODO */ }¦;
items.map(«:function»(x) => {
  return x + "TODO";
}¦);
«Panel:class»class Panel extends Base {
  «openLid:method»openLid(x, {y}) {
    if (x) { return `${y} TODO`; }
    this.draw(x);
  }¦
  «size:method»get size() { return 1; }¦
}¦
// TODO last
""",
    "web/b.ts": """«g:function»function g(o: {a: number}): {b: number} {
  return {b: o.a}; // TODO
}¦
export «Store:class»class Store<T extends {x: number}> implements Kept {
  «open_lid:method»private open_lid<U>(a: {b: number}, c = {d: 1}): Promise<{e: number}> {
    return c; // TODO
  }¦
  «field:function»field = (z: number) => { return z; // TODO
  }¦;
}¦
«Kept:class»interface Kept { a(): void; b: {c: number} }¦
«Alias:class»type Alias = {a: number};¦
export «cb:function»const cb: (x: number) => void = (x) => {
  y(x); // TODO
}¦;
«Mood:class»enum Mood { Good, Bad }¦
""",
    "go/d.go": """package d

«beta:function»func beta(x interface{}) interface{} {
	return x // TODO
}¦

«sum:function»func sum(
	a int,
	b map[string]struct{},
) (int, error) {
	return 1, nil // TODO
}¦

«OpenLid:method»func (r *Lid) OpenLid(fn func(int) bool) {
	fn(1) // TODO
}¦

«Lid:class»type Lid struct {
	n int // TODO
}¦
""",
    "notes.txt": "TODO: beta\nopen_lid\n",
}
def parse(marked: str) -> tuple[str, list[tuple[int, int, str | None, str]]]:
    """The text without its marks, and (start, end, name, kind) of its definitions in bytes."""
    text, open_, found = "", [], []
    for part in re.split(r"(«[^»]*»|¦)", marked):
        if part == "¦":
            found.append((*open_.pop(), len(text.encode())))
        elif part.startswith("«"):
            name, kind = part[1:-1].split(":")
            open_.append((name or None, kind, len(text.encode())))
        else:
            text += part
    return text, sorted((start, end, name, kind) for name, kind, start, end in found)


CODE = [(uri, parse(marked)[0]) for uri, marked in FILES.items()]
#: (uri, start, end, first line, last line, name, kind)
DEFINITIONS = [
    (uri, s, e, raw[:s].count(b"\n") + 1, raw[: max(s, e - 1)].count(b"\n") + 1, name, kind)
    for uri, marked in FILES.items()
    for raw in (parse(marked)[0].encode(),)
    for s, e, name, kind in parse(marked)[1]
]

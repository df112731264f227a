from codequarry.sources.extract import extract_file
from codequarry.sources.store import files_of, scan_tree, unsupported_of


def symbols(path, language, text):
    return {(s[0], s[1]): s for s in extract_file(path, language, text).symbols}


def deps(path, language, text):
    return {(t, n) for t, n, _ in extract_file(path, language, text).deps}


def test_python():
    text = "from .core import Root\nimport os.path\n\nclass Job(Root):\n    limit = 3\n    def go(self, *a): pass\n    def __hide(self): pass\n\ndef tool(x: int) -> str:\n    return ''\n"
    s = symbols("app/jobs.py", "python", text)
    assert s["class", "Job"][2] == "app.jobs" and s["method", "__hide"][3] == "private" and s["method", "go"][6]["params"] == ["self", "*a"]
    assert ("property", "limit") in s and s["function", "tool"][6]["return_type"] == "str"
    assert deps("app/jobs.py", "python", text) == {("import", "app.core.Root"), ("import", "os.path"), ("inherit", "Root")}
    assert extract_file("x.py", "python", "def (").symbols == []


def test_python_relative_levels():
    assert ("import", "a.c.d") in deps("a/b/m.py", "python", "from ..c import d")
    assert ("import", "a.b.d") in deps("a/b/__init__.py", "python", "from . import d")


PHP = r"""<?php
namespace App\Jobs;
use App\Base\Worker;
use App\Base\Queue as Line;
// class Ghost {}
final class Mailer extends Worker implements Sends, \App\Logs {
    private ?string $from = 'x';
    protected static $pool;
    public function send(array $to, int $n = 2): bool { return $this->check($to); }
    private function check($to) { $f = function () { return 1; }; return true; }
}
interface Sends { public function send(array $to); }
trait Loud {}
enum Mode: string { case On = 'on'; }
function helper() {}
require_once ROOT . '/lib' . 'inc/start-up.php';
add_filter('boot', 'start_all');
Event::listen(Paid::class, [Receipt::class, 'print']);
$t = load_thing('Big_Table');
"""


def test_php():
    s = symbols("app/Jobs/Mailer.php", "php", PHP)
    assert s["class", "Mailer"][2] == r"App\Jobs" and s["class", "Mailer"][6] == {"extends": "Worker", "implements": ["Sends", r"\App\Logs"]}
    assert s["method", "check"][3] == "private" and s["method", "send"][6]["return_type"] == "bool" and s["method", "send"][6]["class"] == "Mailer"
    assert s["property", "from"][3] == "private" and s["property", "pool"][3] == "protected"
    assert {("interface", "Sends"), ("trait", "Loud"), ("enum", "Mode"), ("function", "helper")} <= set(s) and ("class", "Ghost") not in s
    d = deps("app/Jobs/Mailer.php", "php", PHP)
    assert {("import", r"App\Base\Worker"), ("import", r"App\Base\Queue"), ("inherit", "Worker"), ("implement", "Sends"), ("load", "inc/start-up.php"), ("register", "start_all"), ("register", "Paid"), ("register", "Receipt"), ("import", "Big_Table")} <= d


RUBY = """require_relative "gear"
module Shop
  module Back
    class Cart < Basket
      include Counts::Items
      extend Store::Finder
      def total(a, b = 1)
        if a
          Price.sum(b)
        end
      end
      def self.build
        Shop::Order.new
      end
    end
  end
end
"""


def test_ruby():
    s = symbols("lib/cart.rb", "ruby", RUBY)
    assert s["class", "Cart"][2] == "Shop::Back" and s["method", "total"][2] == "Shop::Back::Cart" and s["method", "total"][5] == 11 and s["class", "Cart"][5] == 15
    d = deps("lib/cart.rb", "ruby", RUBY)
    assert {("load", "gear"), ("inherit", "Basket"), ("implement", "Counts::Items"), ("implement", "Store::Finder"), ("import", "Price"), ("import", "Shop::Order")} <= d
    assert ("import", "Cart") not in d


RUST = """use crate::net::{Peer, pool::{self, Slot as Place}};
mod inner;
pub struct Hub { wires: Wires, pub name: String }
enum Sort { A, B }
pub trait Spin { fn spin(&self); }
impl Spin for Hub { fn spin(&self) {} }
impl Hub { pub fn open(&self) -> u8 { 1 } fn shut() { let s = "}"; } }
fn util<T>(x: T) where T: Copy {}
"""


def test_rust():
    s = symbols("src/lib.rs", "rust", RUST)
    assert s["property", "wires"][2:4] == ("Hub", "private") and s["property", "name"][3] == "public"
    assert s["method", "open"][2:4] == ("Hub", "public") and s["method", "shut"][3] == "private" and s["function", "util"][3] == "private"
    assert {("module", "inner"), ("enum", "Sort"), ("interface", "Spin"), ("class", "Hub")} <= set(s)
    assert deps("src/lib.rs", "rust", RUST) == {("import", "crate::net::Peer"), ("import", "crate::net::pool"), ("import", "crate::net::pool::Slot"), ("implement", "Spin")}


WEB = """import Box, { open as unlock } from './box'
export { a } from "../lib"
export class Vault extends Box {
  #keys = new Map()
  private size: number = 3;
  static limit = 4
  #turn(): void { if (true) { } }
  async read(x) { return `a ${x} }` }
}
export default function make() {}
"""


def test_typescript_and_components():
    s = symbols("src/vault.ts", "typescript", WEB)
    assert s["property", "keys"][3] == "private" and s["method", "turn"][3] == "private" and s["property", "size"][3] == "private" and s["method", "read"][3] == "public"
    assert ("property", "limit") in s and ("function", "make") in s and s["class", "Vault"][6] == {"extends": "Box"}
    assert deps("src/vault.ts", "typescript", WEB) == {("import", "./box"), ("import", "../lib")}
    v = extract_file("a.vue", "vue", "<template>\n</template>\n<script>\nimport X from './x'\nclass K { go() {} }\n</script>\n")
    assert v.deps == [("import", "./x", 4)] and [(x[1], x[4]) for x in v.symbols] == [("K", 5), ("go", 5)]


def test_scan(spark, tmp_path):
    for name in ("app.py", "main.rs", "deep/a.ts", "lib/e.rb", "cmd.go", "vendor/x.py", ".git/y.py", "out/gen.py", "public/build/z.js"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x = '\xff'\n")
    tree = scan_tree(spark, str(tmp_path), output_dir=str(tmp_path / "out"))
    got = {r.path: r for r in files_of(tree).collect()}
    assert set(got) == {"app.py", "main.rs", "deep/a.ts", "lib/e.rb"} and "�" in got["app.py"].content
    assert [tuple(r) for r in unsupported_of(tree).collect()] == [("go", 1)]

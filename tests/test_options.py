import pytest

from codeseam.functions import options as O
from codeseam.operators import extract


def test_numbers_as_shown():
    assert [O.duration_shown(x) for x in (250, 1500, 125_000)] == ["250ms", "1.5s", "2m 5s"]
    assert O.share_shown(0.935) == "93.5%" and O.interval_shown(0.5, 1) == "[0.500, 1.000]"
    assert O.progress_shown("scan", "start", "x", 61_000) == "[eval 1m 1s] START    scan: x"


def test_values_of_options():
    assert O.whole("7", "--k", 1, 9) == 7 and O.whole("-3", "--k") == -3 and O.share("0.25", "--r") == 0.25
    for bad in (None, "", "x", "1.5", "0", "10", "9" * 20):
        with pytest.raises(ValueError, match="--k"):
            O.whole(bad, "--k", 1, 9)
    for bad in (None, "", "x", "1.01", "-0.1", "nan"):
        with pytest.raises(ValueError, match="--r"):
            O.share(bad, "--r")


def test_one_writer_at_a_time():
    from threading import Thread

    writer, seen = O.Writer(), []

    def work(name):
        seen.append((name, "in", writer.active))
        seen.append((name, "out", writer.active))

    threads = [Thread(target=writer.run, args=(work, i)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(a[0] == b[0] and a[1:] == ("in", True) for a, b in zip(seen[::2], seen[1::2])) and len(seen) == 16 and not writer.active
    with pytest.raises(ZeroDivisionError):
        writer.run(lambda: 1 / 0)
    assert writer.run(lambda: 5) == 5 and not writer.active  # a failure keeps no one out
    runs = []
    stop = writer.every(3600, lambda: runs.append(1))
    stop()
    assert runs == [1]


RUST = """pub struct A<'a> { x: &'a str }
impl<'a> A<'a> {
    pub fn new(x: &'a str) -> Self {
        let c = '}';
        A { x }
    }
}
const N: usize = 3;
pub(crate) async fn run() {
    let s = "{";
}
"""
PHP = """<?php
# a {
final class A {
    const X = 1;
    private static function f(int $a) {
        return '}';
    }
}
function h() {
}
"""
RUBY = """module M
  class A
    def f(x)
      if x
        1
      end
    end
    private
    def g? = 3
    def h
    end
  end
end
"""


def test_symbols_of_more_languages():
    brief = lambda text, language: [(n, k, a, b, e) for n, k, _, a, b, e in extract.symbols_of(text, language)]
    assert brief(RUST, "rust") == [("A", "class", 1, 1, True), ("new", "method", 3, 6, True), ("N", "constant", 8, 8, False), ("run", "function", 9, 11, True)]
    assert brief(PHP, "php") == [("A", "class", 3, 8, True), ("X", "constant", 4, 4, True), ("f", "method", 5, 7, False), ("h", "function", 9, 10, True)]
    assert brief(RUBY, "ruby") == [("M", "class", 1, 13, True), ("A", "class", 2, 12, True), ("f", "method", 3, 7, True), ("g?", "method", 9, 9, False), ("h", "method", 10, 11, False)]
    assert all(extract.symbols_of(x, lang) == [] for x in ("", "\n" * 5, "x" * 100_000) for lang in ("rust", "php", "ruby"))


def test_a_name_can_be_called_and_referred_to():
    got = extract.relations_of("import { a, b } from './x';\na(); a.b; b.c;\n", "typescript")
    assert [(k, n) for k, _, n, _ in got] == [("imports", None), ("calls", "a"), ("references", "a"), ("references", "b")]

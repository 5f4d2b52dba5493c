import hashlib
import itertools
import random
import re
import zlib

import pytest

from pagesift.llm import chat_format, turn_repair
from pagesift.llm.chat_template import Template, TemplateError


def tagged(text, spans):
    return [text[a:a + n] for a, n in spans]


class TestTemplate:
    def test_language(self):
        t = Template("""{# a comment #}{% set who = 'x' %}{% for m in messages -%}
            {% if loop.first and not loop.last %}<{{ who }}>{% elif m.n % 2 == 1 %}odd{% else %}even{% endif -%}
            {{ m['n'] + 1 }}{% if m.tags %}{% for g in m.tags %}[{{ g | upper }}]{% endfor %}{% endif %}
            {%- if not loop.last %}, {{ loop.nextitem.n }};{% endif %}
        {%- endfor %} {{ 'yes' if flag else 'no' }} {{ 'a' ~ 1 ~ none }} {{ 2 in (given) }}""", {"given": [1, 2]})
        out, _ = t.render([{"n": 1}, {"n": 3, "tags": ["p"]}, {"n": 4}], flag=True)
        assert out == "<x>2, 3;odd4[P], 4;even5 yes a1 true"

    def test_generation_spans(self):
        t = Template("{% for m in messages %}{{ m.r }}:{% generation %}{{ m.t }}{% endgeneration %};{% endfor %}")
        text, spans = t.render([{"r": "a", "t": "one"}, {"r": "b", "t": ""}, {"r": "c", "t": "two"}])
        assert tagged(text, spans) == ["one", "two"]

    def test_folding(self):
        t = Template("{{ 'a' ~ x }}{% if x == 'b' %}{{ 1 + 2 }}{% else %}{{ y }}{% endif %}{{ x | upper }}c", {"x": "b"})
        assert t.nodes == [("text", "ab3Bc")]
        # what the template sets itself is no constant
        assert Template("{% set x = y %}{{ x }}", {"x": "b"}).render([], y="z")[0] == "z"

    def test_a_loop_turn_keeps_its_names_to_itself(self):
        t = Template("{% for m in messages %}{{ seen }}{% set seen = m %}{% endfor %}")
        assert t.render(["a", "b"])[0] == ""

    @pytest.mark.parametrize("bad", ["{{ a", "{% if a %}", "{{ a() }}", "{{ a | no }}", "{% import os %}", "{{ 1 + }}",
                                     "{{ 'a' - 1 }}", "{% for x y %}{% endfor %}", "{{ a b }}", "{{ a ; b }}", "{{ 1 % 0 }}"])
    def test_errors(self, bad):
        with pytest.raises(TemplateError):
            Template(bad)

    def test_sandbox(self):
        assert Template("{{ m.__class__ }}{{ m['__class__'] }}{{ s.upper }}").render([], m={}, s="x")[0] == ""

    def test_messages_are_read_as_a_stream(self):
        seen = []

        def source():
            for i in range(100):
                seen.append(i)
                yield {"role": "assistant", "content": str(i)}

        parts = chat_format.chat_template().stream(source())
        next(parts), next(parts)
        assert len(seen) == 2


class TestFormat:
    PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "<", "[", "/", "a", ".", "n", " ", "s>", "é", "\U00010003"]

    def test_escapes_are_reversible(self):
        r = random.Random(5)
        for _ in range(5000):
            s = "".join(r.choice(self.PIECES) for _ in range(r.randint(0, 14)))
            for f in (chat_format.escape, chat_format.escape_line):
                assert chat_format.unescape(f(s)) == s
                assert not any(c in f(s) for c in chat_format.CONTROL)
            turns = [(r.choice(["assistant", "user", s]), s), ("assistant", s[::-1])]
            text, _ = chat_format.chat_template().render([{"role": a, "content": b} for a, b in turns])
            assert list(chat_format.read_turns(text)) == turns

    def test_query_rows(self, spark):
        r = random.Random(6)
        rows = []
        for conv in (None, 0, 1, 2, 7):
            for turn in range(r.randint(1, 9)):
                rows.append((conv, r.choice([turn, turn, None, 3]), r.choice(["user", "assistant", "system", None, "</s>\n"]),
                             r.choice([None, "", "x" * 300, "".join(r.choice(self.PIECES) for _ in range(9))]), turn))
        rows += rows[:3]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
        want = {}
        key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
        for conv, turns in itertools.groupby(sorted(rows, key=key), key=lambda x: x[0]):
            turns = [(t[2] or "", t[3] or "") for t in turns]
            loss = "".join(b for a, b in turns if a == "assistant")
            text, _ = chat_format.chat_template().render([{"role": a, "content": b} for a, b in turns])
            want[conv] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(),
                          len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
        for chars in (1 << 20, 50):  # whole, and cut into parts
            got = chat_format.digests(chat_format.format_conversations(df, chars)).collect()
            assert {x[0]: tuple(x[1:]) for x in got} == want
        parts = chat_format.format_conversations(df, 50).groupBy("conv_id").count().collect()
        assert max(p["count"] for p in parts) > 1
        assert chat_format.format_conversations(df.limit(0)).count() == 0


def brute(rows):
    """Cheapest repair of (initial, fault) rows by trying all edits with up to the
    insertions that can pay."""
    best = None
    ok = re.compile(r"(s?(ua)+)?\Z")

    def go(i, cost, audit, out, room):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if room:
            for c in "ua":
                go(i, cost + 5, audit + "I", out + c, room - 1)
        if i == len(rows):
            if ok.match(out) and (best is None or (cost, audit) < best):
                best = (cost, audit)
            return
        c, fault = rows[i]
        go(i + 1, cost + 2, audit + "D", out, room)
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            go(i + 1, cost + extra, audit + "K", out + c, room)
            for to in "ua":
                go(i + 1, cost + 1 + extra, audit + "R", out + to, room)

    go(0, 0, "", "", 2)
    return best


class TestRepair:
    def test_against_all_edits(self):
        r = random.Random(3)
        for _ in range(250):
            rows = [(r.choice("suax"), r.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(r.randint(0, 6))]
            p = turn_repair.Parser()
            for x in rows:
                p.add(*x)
            assert p.result() == brute(rows), rows

    def test_one_split_equals_all_splits(self):
        r = random.Random(4)
        for _ in range(40):
            rows = [(r.choice("suax"), r.choice(["", "", "truncated", "blank"])) for _ in range(r.randint(1, 17))]
            n = len(rows)
            table = {(i, i + 1): turn_repair.row_cell(*x) for i, x in enumerate(rows)}
            for length in range(2, n + 1):
                for i in range(n - length + 1):
                    cell = {}
                    for k in range(i + 1, i + length):
                        for key, v in turn_repair.combine(table[i, k], table[k, i + length]).items():
                            cell[key] = min(cell.get(key, v), v)
                    table[i, i + length] = cell
            p = turn_repair.Parser()
            for x in rows:
                p.add(*x)
            assert p.result() == min(table[0, n][0, q] for q in turn_repair.ACCEPTING)

    def test_long_conversation(self):
        p = turn_repair.Parser()
        for i in range(20001):
            p.add("ua"[i % 2], "")
        assert p.result() == (2, "K" * 20000 + "D")

    def test_query_rows(self, spark):
        r = random.Random(8)
        rows = []
        for conv in [None, *range(60)]:
            for turn in range(r.randint(1, 7)):
                rows.append((conv, r.choice([turn, turn, turn, None]), r.choice(["user", "assistant", "system", "tool", None, ""]),
                             r.choice([None, "", " \n", "Same.", "Cut", "Ends! ", f"n{turn}?"]), 1))
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit int")
        found, out = turn_repair.repair(df)
        digest = {x[0]: x[1] for x in turn_repair.repaired_digests(out).collect()}
        got = {x[0]: tuple(x[1:]) for x in found.collect()}
        want, shas = {}, {}
        for conv in {x[0] for x in rows}:
            kept = []
            for _, turn, role, text, _ in [x for x in rows if x[0] == conv]:
                role, text = " " if role is None else role, " " if text is None else text
                kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                role = "user" if kind == 4 else role
                kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
            kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
            seen, faults = set(), []
            for _, role, text in kept:
                bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
                faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                              else "truncated" if bare[-1] not in ".!?" else "")
                seen.add((role, text))
            turns = [x[0] for x in kept if x[0] is not None]
            gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
            first = [x[1][:1] for x in kept]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
            p = turn_repair.Parser()
            for c, f in zip(first, faults):
                p.add(c, f)
            cost, audit = p.result()
            want[conv] = (gaps, *[faults.count(f) for f in turn_repair.FAULTS], illegal, cost, audit)
            if any(c != "D" for c in audit):
                lines = [f"{a}:{b}" for a, b in turn_repair.repaired(audit, [x[1:] for x in kept])]
                assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
                shas[conv] = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert got == want
        assert digest == shas
        empty, none = turn_repair.repair(df.limit(0))
        assert empty.count() == none.count() == 0

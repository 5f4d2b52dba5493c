"""Apply many XPath / CSS programs to many pages at once.

Programs are rows (``lang`` column picks xpath or css). They are compiled to
step structs by a pandas UDF, then evaluated set-wise over ``nodes``:

* absolute positional programs (``/html/body/div[2]/p``) need one equi-join of
  ``nodes`` with the program table on ``(match keys, tag_path)`` plus a
  position check against ``sib_path``;
* all others run a frontier loop whose length is the longest program (a
  plan-time loop, not a per-row one). Each step is a join on ``page_id`` plus a
  structural key (parent id, tag) with an interval residual, then a window for
  XPath positions. Nothing leaves the executors.

Result: one row per (page, program) with ``values ARRAY<STRING>`` in document
order (normalized, stripped, empties dropped) and ``invalid``.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions.htmltree import COMMENT
from pagesift.functions.text import html_unescape, non_empty, normalize_text, py_strip
from pagesift.functions.xpath_compile import (anchor_parts, branch_mode, compile_program,
                                              inner_attr_preds, tag_path_regex, tail_positions)
from pagesift.operators.dom import chunks, render_lines, string_value, under_targets

PRED_T = T.StructType([T.StructField("fn", T.StringType()), T.StructField("arg", T.StringType()),
                       T.StructField("val", T.StringType()), T.StructField("neg", T.BooleanType()),
                       T.StructField("grp", T.IntegerType())])
STEP_T = T.StructType([
    T.StructField("axis", T.StringType()), T.StructField("test", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("preds", T.ArrayType(PRED_T)),
    T.StructField("pos", T.IntegerType()), T.StructField("pos_first", T.BooleanType())])
SLOT_T = T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("seq", T.IntegerType()), T.StructField("brk", T.BooleanType()),
    T.StructField("vis", T.BooleanType())])
COMPILED_T = T.StructType([
    T.StructField("branches", T.ArrayType(T.ArrayType(STEP_T))),
    T.StructField("modes", T.ArrayType(T.StringType())),
    T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("tails", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("inner", T.ArrayType(T.ArrayType(T.StructType([
        T.StructField("k", T.IntegerType()), T.StructField("preds", T.ArrayType(PRED_T))])))),
    T.StructField("anchors", T.ArrayType(T.StructType([
        T.StructField("tag", T.StringType()), T.StructField("id", T.StringType()),
        T.StructField("rest", T.StringType()),
        T.StructField("pos", T.ArrayType(T.IntegerType()))]))),
    T.StructField("invalid", T.BooleanType())])


@F.pandas_udf(COMPILED_T)
def compile_udf(program: pd.Series, lang: pd.Series) -> pd.DataFrame:
    out = {"branches": [], "modes": [], "patterns": [], "tails": [], "inner": [], "anchors": [],
           "invalid": []}
    for p, l in zip(program, lang):
        branches, invalid = compile_program(p, l or "xpath")
        out["branches"].append(branches)
        out["modes"].append([branch_mode(b) for b in branches])
        out["patterns"].append([tag_path_regex(b) for b in branches])
        out["tails"].append([tail_positions(b) for b in branches])
        out["inner"].append([inner_attr_preds(b) for b in branches])
        modes = out["modes"][-1]
        out["anchors"].append([dict(zip(("tag", "id", "rest", "pos"), anchor_parts(b)))
                               if m == "anchor" else None for b, m in zip(branches, modes)])
        out["invalid"].append(invalid)
    return pd.DataFrame(out)


def compile_programs(programs: DataFrame, program_col: str = "program",
                     lang_col: str | None = "lang") -> DataFrame:
    lang = F.col(lang_col) if lang_col and lang_col in programs.columns else F.lit("xpath")
    return programs.withColumn("_c", compile_udf(F.col(program_col), lang)).select(
        "*", "_c.branches", "_c.modes", "_c.patterns", "_c.tails", "_c.inner", "_c.anchors",
        "_c.invalid").drop("_c")


def _node_cols(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(prefix + c) for c in (
        "page_id", "node_id", "end_id", "parent_id", "child_ord", "tag", "attrs", "text_slots",
        "anc_ids", "start_seq")])


def _pred_ok(preds: Column, attrs: Column, slots: Column, sv: Column) -> Column:
    first_text = F.coalesce(F.try_element_at(F.transform(slots, lambda s: s.text), F.lit(1)), F.lit(""))
    norm = lambda c: F.regexp_replace(F.regexp_replace(c, r"[ \t\r\n]+", " "), r"^ | $", "")

    def one(p):
        a = attrs[p.arg]
        ok = (F.when(p.fn == "attr_exists", a.isNotNull())
              .when(p.fn == "attr_eq", F.coalesce(a == p.val, F.lit(False)))
              .when(p.fn == "attr_ne", F.coalesce(a != p.val, F.lit(False)))
              .when(p.fn == "text_ne", F.exists(slots, lambda s: s.text != p.val))
              .when(p.fn == "ntext_ne", norm(first_text) != p.val)
              .when(p.fn == "str_ne", sv != p.val)
              .when(p.fn == "nstr_ne", norm(sv) != p.val)
              .when(p.fn == "attr_contains", F.coalesce(F.contains(a, p.val), F.lit(False)))
              .when(p.fn == "attr_starts", F.coalesce(F.startswith(a, p.val), F.lit(False)))
              .when(p.fn == "class_has", F.coalesce(F.array_contains(
                  F.split(F.trim(a), r"\s+"), p.val), F.lit(False)))
              .when(p.fn == "text_exists", F.size(slots) > 0)
              .when(p.fn == "text_eq", F.exists(slots, lambda s: s.text == p.val))
              .when(p.fn == "ntext_eq", norm(first_text) == p.val)
              .when(p.fn == "text_contains", F.contains(first_text, p.val))
              .when(p.fn == "text_starts", F.startswith(first_text, p.val))
              .when(p.fn == "str_eq", sv == p.val)
              .when(p.fn == "nstr_eq", norm(sv) == p.val)
              .when(p.fn == "str_contains", F.contains(sv, p.val))
              .when(p.fn == "str_starts", F.startswith(sv, p.val))
              .otherwise(F.lit(False)))
        return F.when(p.neg, ~ok).otherwise(ok)

    # AND over groups, OR inside a group
    ps = F.coalesce(preds, F.array().cast(T.ArrayType(PRED_T)))
    return F.forall(ps, lambda p: F.exists(F.filter(ps, lambda q: q.grp == p.grp), one))


def _test_ok(test: Column, tag: Column) -> Column:
    return (F.when(test == "node()", F.lit(True))
            .when(test == "*", tag != COMMENT)
            .when(test == "comment()", tag == COMMENT)
            .otherwise(tag == test))


def _string_values(nodes: DataFrame, cand: DataFrame, keys: list[str]) -> DataFrame:
    """XPath string-value (all descendant text, no separators) for candidates."""
    c = cand.select(*keys, F.col("n_node_id").alias("node_id")).distinct()
    sv = string_value(nodes, c, keys).withColumnRenamed("node_id", "n_node_id")
    return cand.join(sv, keys + ["n_node_id"], "left").withColumn("sv", F.coalesce("sv", F.lit("")))


# program text up to which the compiled programs are broadcast
BROADCAST_PROGRAM_CHARS = 2_000_000


def _salted(nodes: DataFrame, programs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a salt beside ``keys``: pages of a key that alone holds more
    than one task's share are dealt over as many salts as shares, and only such a
    key's programs are repeated for each. A page has one salt, so nothing is joined
    twice. At most as many keys as shuffle partitions can be that large."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = nodes.filter(F.col("node_id") == 0).groupBy(*keys).agg(F.count("*").alias("_n"))
    total = pages.agg(F.sum("_n")).first()[0] or 0
    share = max(1, total // parts)
    hot = pages.filter(F.col("_n") > share).select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_k")).checkpoint(eager=True)
    if hot.isEmpty():
        return nodes, programs, []
    hot, one = F.broadcast(hot), F.coalesce("_k", F.lit(1))  # at most ``parts`` rows
    dealt = nodes.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64("page_id"), one).cast("int")).drop("_k")
    copies = programs.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_k")
    return dealt, copies, ["_salt"]


def apply_programs(nodes: DataFrame, programs: DataFrame, match_cols: list[str],
                   prog_cols: list[str], program_col: str = "program",
                   lang_col: str | None = "lang", broadcast_programs: bool | None = None) -> DataFrame:
    """Every program applied to every page sharing ``match_cols``.

    ``nodes`` must carry ``match_cols`` (e.g. ``site`` via ``explode_dom(keep=)``).
    Programs are broadcast if all their texts have at most
    ``BROADCAST_PROGRAM_CHARS`` characters together (the compiled steps grow with
    the text), unless ``broadcast_programs`` says otherwise.
    """
    pcols = list(dict.fromkeys(prog_cols + [program_col]))
    cp = compile_programs(programs.select(*dict.fromkeys(match_cols + pcols + (
        [lang_col] if lang_col and lang_col in programs.columns else []))), program_col, lang_col)
    # compiled once (Python) and reused by every branch below
    cp = cp.checkpoint(eager=True)
    if broadcast_programs is None:
        chars = cp.agg(F.sum(F.length(program_col))).first()[0] or 0
        broadcast_programs = chars <= BROADCAST_PROGRAM_CHARS
    if not broadcast_programs:
        nodes, cp, salted = _salted(nodes, cp, match_cols)
        match_cols = match_cols + salted
    prog = F.broadcast(cp) if broadcast_programs else cp
    roots = nodes.filter(F.col("node_id") == 0).select(
        "page_id", *match_cols, F.col("end_id").alias("root_end"))
    base = roots.join(prog, match_cols)  # J3: pages x programs of their site
    keys = ["page_id"] + pcols

    br = cp.select(*match_cols, *pcols, F.posexplode("branches").alias("br", "steps"),
                   "modes", "patterns", "tails", "inner", "anchors")
    br = br.withColumn("mode", F.element_at("modes", F.col("br") + 1)).withColumn(
        "pattern", F.element_at("patterns", F.col("br") + 1)).withColumn(
        "tail", F.element_at("tails", F.col("br") + 1)).withColumn(
        "anchor", F.element_at("anchors", F.col("br") + 1)).withColumn(
        "inner", F.element_at("inner", F.col("br") + 1)).drop("modes", "patterns", "tails", "anchors")
    # a program without an element step (//text(), /@x) has no node to join on
    br = br.withColumn("mode", F.when(F.exists("steps", lambda x: x.kind == "node"), F.col("mode")).otherwise("general"))
    fast = br.filter(F.col("mode") != "general")
    slow = br.filter(F.col("mode") == "general")
    # plan only the branches the program table needs (one tiny aggregate)
    ns0 = F.filter("steps", lambda x: x.kind == "node")
    last0, term0 = F.try_element_at(ns0, F.lit(-1)), F.try_element_at("steps", F.lit(-1))
    shape = br.select(
        "mode", ((F.size(last0.preds) == 0) & (F.coalesce(last0.pos, F.lit(0)) >= 0)).alias("plain"),
        term0.kind.alias("kind"), (term0.axis == "desc_child").alias("deep"),
        (F.coalesce(F.size("inner"), F.lit(0)) > 0).alias("inner")).distinct().collect()
    modes = {r["mode"] for r in shape}
    need_inner = any(r["inner"] for r in shape if r["mode"] == "abs")
    need_pred = any(not r["plain"] for r in shape if r["mode"] != "general")
    kinds = {("text_deep" if r["kind"] == "text" and r["deep"] else r["kind"]) for r in shape}

    # ---- fast paths: no join loop ------------------------------------------
    # abs:     absolute child path -> equi-join on (match, tag_path) + sib_path check
    # pattern: only / and // name steps -> equi-join on (match, last tag) + regex on tag_path
    node_steps = lambda s: F.filter(s, lambda x: x.kind == "node")
    ns = node_steps(F.col("steps"))
    last = F.try_element_at(ns, F.lit(-1))
    is_abs = F.col("mode") == "abs"
    plain = (F.size(last.preds) == 0) & (F.coalesce(last.pos, F.lit(0)) >= 0)
    fast = fast.select(
        *match_cols, *pcols, "br", "steps", "mode", "pattern", "tail", "anchor", "inner",
        last.alias("last"),
        plain.alias("plain"), last.test.alias("tag"),
        F.concat(F.lit("/"), F.array_join(F.transform(ns, lambda x: x.test), "/")).alias("tag_path"),
        # positions checked against sib_path; the last one only when no predicate
        F.transform(ns, lambda x, i: F.when((i == F.size(ns) - 1) & ~plain, F.lit(0))
                    .otherwise(F.coalesce(x.pos, F.lit(0)))).alias("pp"))
    fprog = F.broadcast(fast) if broadcast_programs else fast
    ncols = nodes.select("page_id", *match_cols, "tag", "tag_path", "node_id", "parent_id",
                         "sib_path", "attrs", "text_slots", "start_seq", "anc_ids")
    hits = []
    if "abs" in modes:
        f_abs = ncols.drop("tag").join(fprog.filter(F.col("mode") == "abs").drop("tag"),
                                       match_cols + ["tag_path"])
        f_abs = f_abs.filter(F.forall(F.arrays_zip(F.col("pp"), F.col("sib_path")),
                                      lambda z: (z.pp == 0) | (z.pp == z.sib_path)))
        # attribute predicates of inner steps: checked on the ancestor at that
        # depth (one explode + one join on page), failing matches anti-joined
        chk = None if not need_inner else f_abs.filter(F.size("inner") > 0).select(
            *keys, "br", "node_id", "anc_ids", F.explode("inner").alias("ip"))
        if chk is not None:
            chk = chk.withColumn("anc", F.element_at("anc_ids", F.col("ip.k") + 1)).join(
                nodes.select("page_id", F.col("node_id").alias("anc"), F.col("attrs").alias("a_attrs")),
                ["page_id", "anc"])
            bad = chk.filter(~_pred_ok(F.col("ip.preds"), F.col("a_attrs"),
                                       F.array().cast(T.ArrayType(SLOT_T)), F.lit(""))).select(
                *keys, "br", "node_id").distinct()
            f_abs = f_abs.join(bad, [*keys, "br", "node_id"], "left_anti")
        hits.append(f_abs)
    if "pattern" in modes:
        f_pat = ncols.join(fprog.filter(F.col("mode") == "pattern").withColumnRenamed(
            "tag_path", "prog_path"), match_cols + ["tag"]).filter(
            F.expr("regexp_like(tag_path, pattern)")).drop("prog_path")
        # positions of the steps after the last // are read from the end of sib_path
        f_pat = f_pat.filter(F.forall(
            F.arrays_zip(F.reverse("tail").alias("tp"), F.reverse("sib_path").alias("sp")),
            lambda z: z.tp.isNull() | (z.tp == 0) | (z.tp == z.sp)))
        hits.append(f_pat.drop("tag"))
    if "anchor" in modes:
        # anchors by id (equi on site + id), then the path below them (equi on page + tag_path)
        ap = fprog.filter(F.col("mode") == "anchor").drop("tag", "tag_path")
        anc = nodes.select("page_id", *match_cols, F.col("attrs")["id"].alias("aid"),
                           F.col("tag").alias("atag"), F.col("tag_path").alias("a_path"),
                           F.col("sib_path").alias("a_sib")).filter(F.col("aid").isNotNull())
        anc = anc.join(ap, match_cols).filter(
            (F.col("aid") == F.col("anchor.id"))
            & ((F.col("anchor.tag") == "*") | (F.col("anchor.tag") == F.col("atag"))))
        anc = anc.withColumn("tag_path", F.concat("a_path", "anchor.rest"))
        f_anc = ncols.drop("tag").join(anc.drop(*match_cols), ["page_id", "tag_path"])
        below = F.slice("sib_path", F.size("a_sib") + 1, F.size("anchor.pos"))
        f_anc = f_anc.filter(
            (F.slice("sib_path", 1, F.size("a_sib")) == F.col("a_sib"))
            & F.forall(F.arrays_zip(F.col("anchor.pos").alias("ap"), below.alias("sp")),
                       lambda z: (z.ap == 0) | (z.ap == z.sp)))
        hits.append(f_anc.drop("aid", "atag", "a_path", "a_sib"))
    fhit = reduce(lambda x, y: x.unionByName(y), hits).drop("anc_ids", "inner") if hits else None
    fplain = fhit.filter("plain") if fhit is not None else None
    # last step with predicates (or last()): position among matching siblings
    fpred = None if fhit is None or not need_pred else fhit.filter(~F.col("plain")).withColumn(
        "ok", _pred_ok(F.col("last.preds"), F.col("attrs"), F.col("text_slots"), F.lit("")))
    wk = [*keys, "br", "parent_id"]
    lpos = F.col("last.pos")
    hit = lambda rn, cnt: F.when(lpos == -1, rn == cnt).otherwise(rn == lpos)
    if fpred is not None:
        fpred = fpred.withColumn("keep", F.col("ok") & (
            lpos.isNull()
            | (F.col("last.pos_first") & hit(F.row_number().over(Window.partitionBy(*wk).orderBy("node_id")),
                                             F.count(F.lit(1)).over(Window.partitionBy(*wk))))
            | (~F.col("last.pos_first") & hit(
                F.row_number().over(Window.partitionBy(*wk, "ok").orderBy("node_id")),
                F.count(F.lit(1)).over(Window.partitionBy(*wk, "ok")))))).filter("keep").drop("ok", "keep")
    payload = ["attrs", "text_slots", "start_seq"]
    fparts = [x for x in (fplain, fpred) if x is not None]
    fdone = None
    if fparts:
        fdone = reduce(lambda x, y: x.unionByName(y), fparts).select(
            *keys, "br", "steps", "node_id", *payload, F.size(node_steps(F.col("steps"))).alias("i"))

    # ---- general path: frontier loop ---------------------------------------
    meta = [] if "general" not in modes else slow.select(F.posexplode("steps").alias("i", "s")).select(
        "i", "s.axis", "s.kind",
        F.exists("s.preds", lambda p: p.fn.startswith("str") | p.fn.startswith("nstr")).alias("sv"),
        (F.col("s.test").isin("*", "node()", "comment()")).alias("wild"), "s.test").distinct().collect()
    n_steps = max([r["i"] + 1 for r in meta if r["kind"] == "node"], default=0)
    front = slow.join(base.select("page_id", *match_cols, *pcols, "root_end"),
                      match_cols + pcols).select(
        *keys, "br", "steps", F.lit(-1).alias("node_id"), F.col("root_end").alias("end_id"),
        F.lit(-2).alias("parent_id"), F.lit(0).alias("child_ord"),
        F.array().cast(T.ArrayType(T.IntegerType())).alias("anc_ids"),
        F.lit(None).cast("map<string,string>").alias("attrs"),
        F.lit(None).cast(T.ArrayType(SLOT_T)).alias("text_slots"), F.lit(None).cast("int").alias("start_seq"))
    done = [fdone] if fdone is not None else []
    N = _node_cols(nodes, "n_")
    for i in range(n_steps):
        step = F.element_at("steps", i + 1)
        is_node = (F.size("steps") > i) & (step.kind == "node")
        done.append(front.filter(~is_node).select(*keys, "br", "steps", "node_id", *payload,
                                                  F.lit(i).alias("i")))
        act = front.filter(is_node).withColumn("st", step)
        here = [r for r in meta if r["i"] == i and r["kind"] == "node"]
        axes = sorted({r["axis"] for r in here})
        need_sv = any(r["sv"] for r in here)
        # only elements some program can select at this step travel to the join
        Ni = N if any(r["wild"] for r in here) else N.filter(
            F.col("n_tag").isin(*sorted({r["test"] for r in here})))
        parts = []
        same_page = F.col("page_id") == F.col("n_page_id")
        for ax in axes:
            a = act.filter(F.col("st.axis") == ax)
            if ax == "child":
                c = a.join(Ni, same_page & (F.col("n_parent_id") == F.col("node_id")))
                pk, desc = F.col("node_id"), False
            elif ax in ("desc_child", "descendant", "descendant_self"):
                lo = (F.col("n_node_id") >= F.col("node_id")) if ax == "descendant_self" else (
                    F.col("n_node_id") > F.col("node_id"))
                rng = lo & (F.col("n_node_id") <= F.col("end_id"))
                named = a.filter(~F.col("st.test").isin("*", "node()", "comment()"))
                wild = a.filter(F.col("st.test").isin("*", "node()", "comment()"))
                c = named.join(Ni, same_page & (F.col("n_tag") == F.col("st.test")) & rng).unionByName(
                    wild.join(Ni, same_page & rng))
                pk, desc = (F.col("n_parent_id") if ax == "desc_child" else F.col("node_id")), False
            elif ax == "self":
                c = a.join(Ni, same_page & (F.col("n_node_id") == F.col("node_id")))
                pk, desc = F.col("node_id"), False
            elif ax == "parent":
                c = a.join(Ni, same_page & (F.col("n_node_id") == F.col("parent_id")))
                pk, desc = F.col("node_id"), False
            elif ax in ("following_sibling", "preceding_sibling"):
                cmp = (F.col("n_child_ord") > F.col("child_ord")) if ax == "following_sibling" else (
                    F.col("n_child_ord") < F.col("child_ord"))
                c = a.join(Ni, same_page & (F.col("n_parent_id") == F.col("parent_id")) & cmp)
                pk, desc = F.col("node_id"), ax == "preceding_sibling"
            elif ax in ("ancestor", "ancestor_self"):
                e = a.withColumn("anc", F.explode(
                    F.col("anc_ids") if ax == "ancestor_self" else F.slice(
                        "anc_ids", 1, F.greatest(F.size("anc_ids") - 1, F.lit(0)))))
                c = e.join(Ni, same_page & (F.col("n_node_id") == F.col("anc"))).drop("anc")
                pk, desc = F.col("node_id"), True
            else:
                continue
            parts.append(c.withColumn("pk", pk).withColumn(
                "ok_", F.lit(-1) if desc else F.lit(1)))
        if not parts:
            front = act.limit(0).select(front.columns)
            continue
        cand = reduce(lambda x, y: x.unionByName(y), parts)
        cand = cand.filter(_test_ok(F.col("st.test"), F.col("n_tag")))
        if need_sv:
            cand = _string_values(nodes, cand, keys + ["br"])
        else:
            cand = cand.withColumn("sv", F.lit(""))
        cand = cand.withColumn("ok", _pred_ok(F.col("st.preds"), F.col("n_attrs"),
                                              F.col("n_text_slots"), F.col("sv")))
        w_all = Window.partitionBy(*keys, "br", "pk").orderBy(F.col("n_node_id") * F.col("ok_"))
        w_ok = Window.partitionBy(*keys, "br", "pk", "ok").orderBy(F.col("n_node_id") * F.col("ok_"))
        w_all_u = Window.partitionBy(*keys, "br", "pk")
        w_ok_u = Window.partitionBy(*keys, "br", "pk", "ok")
        pos = F.col("st.pos")
        hit = lambda rn, cnt: F.when(pos == -1, rn == cnt).otherwise(rn == pos)
        cand = cand.withColumn("keep", F.col("ok") & (
            pos.isNull()
            | (F.col("st.pos_first") & hit(F.row_number().over(w_all), F.count(F.lit(1)).over(w_all_u)))
            | (~F.col("st.pos_first") & hit(F.row_number().over(w_ok), F.count(F.lit(1)).over(w_ok_u)))))
        front = cand.filter("keep").select(
            *keys, "br", "steps", F.col("n_node_id").alias("node_id"),
            F.col("n_end_id").alias("end_id"), F.col("n_parent_id").alias("parent_id"),
            F.col("n_child_ord").alias("child_ord"), F.col("n_anc_ids").alias("anc_ids"),
            F.col("n_attrs").alias("attrs"), F.col("n_text_slots").alias("text_slots"),
            F.col("n_start_seq").alias("start_seq"),
        ).dropDuplicates(keys + ["br", "node_id"])
    if "general" in modes:
        done.append(front.select(*keys, "br", "steps", "node_id", *payload, F.lit(n_steps).alias("i")))
    if not done:   # only invalid programs
        return base.select(*keys, *[c for c in match_cols if c not in (*keys, "_salt")],
                           F.array().cast("array<string>").alias("values"), F.col("invalid"))
    res = reduce(lambda x, y: x.unionByName(y), done).filter(F.col("node_id") >= 0)
    css = None
    if lang_col and lang_col in cp.columns:   # one flag per program, sized like the program table
        css = cp.select(*pcols, (F.col(lang_col) == "css").alias("is_css")).distinct()
        css = F.broadcast(css) if broadcast_programs else css
    values = _terminal_values(nodes, res, keys, kinds, css, pcols)
    out = base.select(*keys, *[c for c in match_cols if c not in (*keys, "_salt")], "invalid").join(
        values, keys, "left")
    return out.select(*keys, *[c for c in match_cols if c not in (*keys, "_salt")],
                      F.coalesce("values", F.array().cast("array<string>")).alias("values"),
                      F.col("invalid"))


def css_normalize(c: Column) -> Column:
    """CSS results: one unescape, strip, then collapse runs of spaces."""
    return F.regexp_replace(py_strip(html_unescape(c)), "  +", " ")


def _terminal_values(nodes: DataFrame, res: DataFrame, keys: list[str],
                     kinds: set | None = None, css: DataFrame | None = None,
                     pcols: list[str] | None = None) -> DataFrame:
    """Turn result nodes into strings: element -> rendered text, text() -> raw
    chunks, @attr -> attribute value. Then normalize, drop empties, order."""
    term = F.element_at("steps", F.col("i") + 1)
    r = res.withColumn("t", F.when(F.size("steps") > F.col("i"), term)).drop("steps")
    # result rows carry attrs / text_slots / start_seq: no re-join with the node table
    kind = F.coalesce(F.col("t.kind"), F.lit("node"))
    kinds = kinds or {"node", "text", "text_deep", "attr"}
    parts = []  # each: keys, ord (document position), uid (dedupe identity), raw
    if "text" in kinds:
        parts.append(r.filter((kind == "text") & (F.col("t.axis") != "desc_child")).select(
            *keys, F.explode("text_slots").alias("s"), "t").filter(
            F.col("t.pos").isNull() | (F.col("s.idx") == F.col("t.pos"))).select(
            *keys, F.col("s.seq").alias("ord"), F.concat(F.lit("t"), F.col("s.seq")).alias("uid"),
            F.col("s.text").alias("raw")))
    # text chunks under result elements: ancestor-set equi-join, no range join
    ck = chunks(nodes) if kinds & {"text_deep", "node"} else None
    if "text_deep" in kinds:
        sub = r.filter((kind == "text") & (F.col("t.axis") == "desc_child")).select(*keys, "node_id")
        parts.append(under_targets(ck, sub.select("page_id", "node_id")).join(
            sub.withColumnRenamed("node_id", "target_id"), ["page_id", "target_id"]).select(
            *keys, F.col("chunk.seq").alias("ord"), F.concat(F.lit("t"), F.col("chunk.seq")).alias("uid"),
            F.col("chunk.text").alias("raw")))
    if "attr" in kinds:
        parts.append(r.filter(kind == "attr").select(
            *keys, F.col("start_seq").alias("ord"),
            F.concat(F.lit("a"), F.col("node_id"), F.lit("@"), F.col("t.test")).alias("uid"),
            F.col("attrs")[F.col("t.test")].alias("raw")))
    if "node" in kinds:
        el = r.filter(kind == "node").select(*keys, "node_id", "start_seq")
        el_pairs = under_targets(ck, el.select("page_id", "node_id")).groupBy(
            "page_id", F.col("target_id").alias("node_id")).agg(F.collect_list("chunk").alias("chunks"))
        parts.append(el.join(el_pairs, ["page_id", "node_id"], "left").select(
            *keys, F.col("start_seq").alias("ord"), F.concat(F.lit("e"), F.col("node_id")).alias("uid"),
            render_lines(F.coalesce("chunks", F.array().cast(T.ArrayType(SLOT_T)))).alias("raw")))
    allv = reduce(lambda x, y: x.unionByName(y), parts).dropDuplicates(keys + ["uid"])
    allv = allv.filter(F.col("raw").isNotNull())
    if css is not None:
        allv = allv.join(css, pcols, "left")
        v = F.when(F.coalesce("is_css", F.lit(False)), css_normalize(F.col("raw"))).otherwise(normalize_text(F.col("raw")))
    else:
        v = normalize_text(F.col("raw"))
    allv = non_empty(allv, [*keys, "ord", "uid"], v, "v")
    return allv.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("ord", "uid", "v"))), lambda x: x.v).alias("values"))

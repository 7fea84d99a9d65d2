"""Edit scripts, placing, applying and merging of hunks against plain versions; the queries without SQL against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from patchlens.functions import patches
from patchlens.operators import patching
from patchlens.plans import patch_queries

SF = "/root/testdata/sf0.001"


def common(a, b):
    """Length of a longest common subsequence, by the table of all prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = list(row)
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def some(rng, most, letters):
    text = "".join(rng.choice("abcdefghijklmnop"[:letters]) + "\n" for _ in range(rng.randint(0, most)))
    return text if rng.random() < 0.7 else text[:-1]


def altered(rng, text, share):
    return "".join(y for x in patches.cut(text) for y in ([] if rng.random() < share else ["new %d\n" % rng.randint(0, 3)] if rng.random() < share else [x, "more\n"] if rng.random() < share else [x]))


@pytest.mark.parametrize("seed", range(4))
def test_scripts_are_shortest_and_patches_apply(seed):
    rng = random.Random(seed)
    for _ in range(500):
        a = some(rng, 14, rng.choice((2, 4, 8)))
        b = some(rng, 14, rng.choice((2, 4, 8))) if rng.random() < 0.4 else altered(rng, a, 0.2) + rng.choice(("", "z\n", "q"))
        old, new = patches.cut(a), patches.cut(b)
        assert sum(n - i + m - j for i, n, j, m in patches.edits(old, new)) == len(old) + len(new) - 2 * common(old, new)
        patch = patches.unified(a, b, "f", rng.choice((0, 1, 3)))
        if a == b:
            assert patch == ""
            continue
        ((path, hunks),) = patches.sections(patch)
        done = patches.apply(a, path, hunks, 0, False)
        assert path == "f" and done.text == b and not done.failed and done.rejects == ""


def plain_place(lines, hunks, fuzz):
    """Every place of every hunk, one after the other."""
    shift, least, out, grown = 0, 0, [], 0
    for h in hunks:
        old, (before, after) = h.old(), h.around()
        said, found = h.start - 1, None
        for f in range(min(fuzz, max(before, after)) + 1):
            head, tail = max(0, f + before - max(before, after)), max(0, f + after - max(before, after))
            run = old[head : len(old) - tail]
            places = [p for p in range(least, len(lines) - len(run) + 1) if run and lines[p : p + len(run)] == run]
            if f + before - max(before, after) < 0 and h.start <= 1:
                places = [p for p in places if p == 0 and (f + after - max(before, after) >= 0 or len(run) == len(lines))]
            elif f + after - max(before, after) < 0:
                places = [p for p in places if p == len(lines) - len(run)]
            if places:
                found = min(places, key=lambda p: (abs(p - (said + shift + head)), -p)) - head
                break
        out.append(None if found is None else (found + 1 + grown, found - said, f))
        if found is not None:
            shift, least = found - said, max(0, found) + len(old)
            grown += len(h.new()) - len(old)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_places_equal_a_full_search(seed):
    rng = random.Random(seed)
    fuzzy = shifted = lost = 0
    for _ in range(600):
        base = some(rng, 30, rng.choice((3, 16)))
        patch = patches.unified(base, altered(rng, base, 0.08), "f")
        mine = "own\n" * rng.randint(0, 4) + altered(rng, base, 0.08)
        for path, hunks in patches.sections(patch):
            want = plain_place(patches.cut(mine), hunks, 2)
            got = [None if h.line is None else (h.line, h.offset, h.fuzz) for h in patches.place(patches.cut(mine), hunks)]
            assert got == want
            fuzzy += sum(x is not None and x[2] > 0 for x in got)
            shifted += sum(x is not None and x[1] != 0 for x in got)
            lost += got.count(None)
    assert fuzzy > 10 and shifted > 10 and lost > 10


def plain_merge(base, ours, theirs):
    """By the lines of base that both versions keep: what stands between two of them is taken, or a conflict."""
    kept = [{}, {}]
    for side, version in enumerate((ours, theirs)):
        at, j = 0, 0
        for i, n, a, b in [*patches.edits(base, version), (len(base), len(base), len(version), len(version))]:
            while at < i:
                kept[side][at] = j
                at, j = at + 1, j + 1
            at, j = n, b
    both = [i for i in range(len(base)) if i in kept[0] and i in kept[1]]
    out, conflicts, last = [], 0, (-1, -1, -1)
    for i in [*both, len(base)]:
        here = (i, kept[0].get(i, len(ours)), kept[1].get(i, len(theirs)))
        o, a, b = base[last[0] + 1 : here[0]], ours[last[1] + 1 : here[1]], theirs[last[2] + 1 : here[2]]
        if a == b or b == o:
            out += a
        elif a == o:
            out += b
        else:
            conflicts += 1
        out += base[i : i + 1]
        last = here
    return out, conflicts


@pytest.mark.parametrize("seed", range(3))
def test_merges(seed):
    rng = random.Random(seed)
    for _ in range(600):
        base = "".join(f"{i}\n" for i in range(rng.randint(0, 12)))
        ours, theirs = altered(rng, base, 0.1), altered(rng, base, 0.1)
        text, conflicts = patches.merged(base, ours, theirs)
        want, number = plain_merge(*map(patches.cut, (base, ours, theirs)))
        assert conflicts == number == text.count("<<<<<<<")
        if not conflicts:
            assert text == "".join(want)
        assert patches.merged(base, ours, base) == (ours, 0) and patches.merged(base, base, theirs) == (theirs, 0) and patches.merged(base, ours, ours) == (ours, 0)


def test_merge_mode_keeps_both_sides_of_what_does_not_fit():
    base = "".join(f"line {i}\n" for i in range(20))
    patch = patches.unified(base, base.replace("line 4\n", "theirs 4\n").replace("line 15\n", "theirs 15\n"), "f")
    ((path, hunks),) = patches.sections(patch)
    done, conflicts = patches.apply_merging(base.replace("line 4\n", "ours 4\n"), path, hunks, ("A", "B"))
    assert conflicts == 1 and done.failed == [1]
    assert done.text == base.replace("line 4\n", "<<<<<<< A\nours 4\n=======\ntheirs 4\n>>>>>>> B\n").replace("line 15\n", "theirs 15\n")


def test_rejects_fuzz_white_space_and_applied_before():
    base = "".join(f"line {i}\n" for i in range(20))
    new = base.replace("line 9\n", "nine\n")
    ((path, hunks),) = patches.sections(patches.unified(base, new, "d/f.c"))
    again = lambda: next(iter(patches.sections(patches.unified(base, new, "d/f.c"))))[1]
    assert patches.apply(base.replace("line", "line  "), path, hunks).text == base.replace("line", "line  ").replace("line   9\n", "nine\n")
    assert patches.apply(base.replace("line", "line  "), path, again(), spaces=False).failed == [1]
    fuzzy = patches.apply(base.replace("line 6\n", "six\n"), path, again())
    assert not fuzzy.failed and fuzzy.hunks[0].fuzz == 1 and fuzzy.text == new.replace("line 6\n", "six\n")
    assert "succeeded at 7 with fuzz 1" in fuzzy.said()
    lost = patches.apply("other\n", path, again())
    assert lost.failed == [1] and lost.text == "other\n" and lost.rejects.startswith("--- d/f.c\n+++ d/f.c\n@@ -7,7 +7,7 @@\n line 6\n") and "1 out of 1 hunks FAILED" in lost.said()
    done = patches.apply(new, path, again())
    assert done.applied_before and done.text == new
    gone = patches.apply(None, path, again())
    assert gone.text is None and "can't find file to patch" in gone.said()
    ((path, hunks),) = patches.sections(patches.unified(None, "a\nb", "new"))
    assert patches.apply(None, path, hunks).text == "a\nb"


def test_long_texts_take_time_in_proportion():
    base = "".join(f"line {i}\n" for i in range(100_000))
    new = "".join(f"x {i}\n" if i % 500 == 7 else f"line {i}\n" for i in range(100_000))
    began = time.time()
    ((path, hunks),) = patches.sections(patches.unified(base, new, "f"))
    done = patches.apply("own\n" * 50 + base, path, hunks)
    assert len(hunks) == 200 and not done.failed and {h.offset for h in hunks} == {50} and done.text == "own\n" * 50 + new
    assert time.time() - began < 20


def test_null_and_empty_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a\n", None), (3, None, "a\n"), (4, "", ""), (5, "a\n", "a")], "i int, old string, new string")
    rows = patching.applied(patching.differences(df, F.col("old"), F.col("new"), F.lit("f")), F.col("old"), F.col("patch")).orderBy("i").collect()
    assert [r.patch == "" for r in rows] == [True, False, False, True, False]
    assert [r.applied.text for r in rows] == [None, "", "a\n", "", "a"]
    assert patching.merged(df, F.col("old"), F.col("new"), F.col("new")).filter("merged.conflicts > 0").count() == 0
    assert patching.dry_run(df.filter("false"), F.col("old"), F.col("new")).count() == 0


def sources(spark):
    return {r.doc_id: r for r in patch_queries._versions(spark, SF).collect()}


def test_dry_run_of_documents(spark):
    found, docs = {}, sources(spark)
    for r in patch_queries.patch_dry_run(spark, SF).collect():
        found.setdefault(r.doc_id, []).append((r.hunk, r.line, r.offset, r.fuzz) if r.placed else (r.hunk, None, 0, 0))
    assert sum(map(len, found.values())) > 100
    for i, d in docs.items():
        want = []
        for _, hunks in patches.sections(patches.unified(d.v1, d.v2, "f")):
            want = [(h.number, *(w or (None, 0, 0))) for h, w in zip(hunks, plain_place(patches.cut(d.local), hunks, 2), strict=True)]
        assert sorted(found.get(i, [])) == want


def test_application_to_documents(spark):
    docs, seen = sources(spark), 0
    for r in patch_queries.patch_apply(spark, SF).collect():
        d = docs[r.doc_id]
        failed = [int(x) for x in r.failed_hunks.split(",") if x]
        assert r.said_failed == r.failed_hunks and bool(failed) == (r.status == "Rejected: Failed Hunks") == bool(r.rejects)
        assert (r.failed_files == f"src/f{r.doc_id}.c") == bool(failed)
        # with the failed hunks left out, the changes of the others are all there
        hunks = [h for _, hs in patches.sections(patches.unified(d.v1, d.v2, "f")) for h in hs]
        assert r.total_hunks == len(hunks)
        fresh = [x for h in hunks if h.number not in failed for mark, x in h.lines if mark == "+"]
        result = patches.cut(r.result)
        assert all(x in result or x + "\n" in result for x in fresh)
        gone = sum(mark == "-" for h in hunks if h.number not in failed for mark, _ in h.lines)
        assert len(result) == len(patches.cut(d.local)) + len(fresh) - gone
        seen += len(failed)
    assert seen > 10


def test_merge_mode_of_documents(spark):
    blocks, docs = {}, sources(spark)
    for r in patch_queries.patch_merge(spark, SF).collect():
        blocks.setdefault(r.doc_id, []).append(r)
    assert blocks
    for i, d in docs.items():
        mine = sorted(blocks.get(i, []), key=lambda r: r.hunk_number)
        assert [r.hunk_number for r in mine] == list(range(1, len(mine) + 1))
        sections = list(patches.sections(patches.unified(d.v1, d.v2, "f")))
        number = patches.apply_merging(d.local, "f", sections[0][1], ("ours", "theirs"))[1] if sections else 0
        assert len(mine) == number
        for r in mine:
            assert r.merge_conflict.startswith("<<<<<<< DOWNSTREAM (version 14)\n") and f"commit c{i}" in r.merge_conflict and r.words > 0


def test_conflict_records_of_documents(spark):
    docs, short = sources(spark), 0
    done = {r.doc_id: r for r in patch_queries.patch_apply(spark, SF).collect()}
    found = {r.doc_id: r for r in patch_queries.conflict_records_whole(spark, SF).collect()}
    for i, d in docs.items():
        sections = list(patches.sections(patches.unified(d.v1, d.v2, f"src/f{i}.c")))
        if i % 10 == 9:
            assert (i in found) == bool(sections)
            if sections:
                short += 1
                assert (found[i].file_name, found[i].total_hunks, found[i].blocks, found[i].reason) == (f"src/f{i}.c", 0, 0, f"File 'src/f{i}.c' is missing in downstream repo")
            continue
        assert (i in found) == bool(done[i].failed_hunks)
        if i in found:
            r = found[i]
            merged, blocks = patches.apply_merging(d.local, f"src/f{i}.c", sections[0][1], ("ours", "theirs"))
            assert (r.file_name, r.total_hunks, r.failed, r.blocks, r.reason) == (f"src/f{i}.c", done[i].total_hunks, done[i].failed_hunks, blocks, None)
            assert r.rej_file_content == "```diff\n" + done[i].rejects.strip() + "\n```" and merged.text.strip() in r.downstream_file_content_with_markers and d.v2.strip() in r.upstream_file_content
    assert short > 2 and len(found) > short + 5


def test_templates(spark):
    from patchlens.functions import prompts

    df = spark.createDataFrame([("a", None)], "x string, y string")
    one = lambda c: df.select(c).first()[0]
    assert one(prompts.filled("{x} and {{y}} {y}.", {"x": F.col("x"), "y": F.col("y")})) == "a and {y} ."
    assert one(prompts.filled("", {})) == ""
    with pytest.raises(KeyError):
        prompts.filled("{z}", {"x": F.col("x")})


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_loosened_as_one_text():
    rng = random.Random(11)
    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace() and chr(i) != "\n"]
    for _ in range(3000):
        lines = ["".join(rng.choice(["a", "é", " ", "  ", rng.choice(spaces)]) for _ in range(rng.randint(0, 5))) + "\n" for _ in range(rng.randint(0, 5))]
        lines += rng.choice(([], ["end"], [" "], [""], ["no end", "x\n"]))
        assert patches.alike(lines, True) == [" ".join(x.split()) for x in lines] and patches.alike(lines, False) == lines


def test_a_patch_is_read_once_for_all_versions(spark, monkeypatch):
    base = "".join(f"line {i}\n" for i in range(20))
    patch = patches.unified(base, base.replace("line 9\n", "nine\n"), "f") + patches.unified("a\n", "b\n", "g")
    texts = [base, base.replace("line", "line  "), None, "other\n", base.replace("line 9\n", "nine\n"), base + "a\n"]
    df = spark.createDataFrame([(1, texts, patch), (2, texts, None), (3, None, patch)], "i int, texts array<string>, patch string")
    each = {r.i: r.forwarded for r in patching.forwarded_each(df, F.col("texts"), F.col("patch")).collect()}
    alone = patching.forwarded(df.select("i", F.posexplode("texts").alias("p", "text"), "patch"), F.col("text"), F.col("patch")).collect()
    assert each[3] is None and len(alone) == 12 and all(each[r.i][r.p] == r.forwarded for r in alone)
    assert {x.result for x in each[1]} == {"success", "failure", "skipped"} and {x.result for x in each[2]} == {"skipped"}
    # versions of a document are made once, and their patches read once for each
    assert plan(patch_queries.forwarded_patches(spark, SF)).count("([.!?]) +") == 1
    read, sections = [], patches.sections
    monkeypatch.setattr(patches, "sections", lambda given: read.append(1) or sections(given))
    ready = patching.prepared(patch)
    assert [patching.outcome(x, ready, patching.TRIES)["result"] for x in texts] == [x.result for x in each[1]] and len(read) == 1


def test_conflict_sides_equal_a_reading_line_by_line(spark):
    import re

    from patchlens.functions import diff

    rng = random.Random(3)
    pieces = ["<<<<<<< a", "<<<<<<<", "=======", ">>>>>>>", ">>>>>>> b", "", "x", "  y ", "x =======", "<<<<<< z"]
    given = ["".join(rng.choice(pieces) + rng.choice(("\n", "\n", "\r\n", " ")) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*given, None])], "i int, text string")
    seen = 0
    for r in df.select("i", "text", diff.conflicts(F.col("text"), F.lit("14"), F.lit("c")).alias("found")).collect():
        if r.text is None:
            assert r.found is None
            continue
        want = []
        for block in re.findall(r"(?s)<<<<<<<.*?=======.*?>>>>>>>", r.text):
            sides, mode = {"<<<<<<<": [], "=======": [], ">>>>>>>": []}, ""
            for line in block.splitlines():
                if line[:7] in sides:
                    mode = line[:7]
                else:
                    sides[mode].append(line)
            want.append("<<<<<<< DOWNSTREAM (version 14)\n" + "\n".join(sides["<<<<<<<"]) + "\n=======\n" + "\n".join(sides["======="]) + "\n>>>>>>> UPSTREAM PATCH (commit c)")
        assert [x.merge_conflict for x in r.found] == want and [x.hunk_number for x in r.found] == list(range(1, len(want) + 1))
        seen += len(want)
    assert seen > 100


def test_conflict_records_are_made_in_one_pass(spark):
    from patchlens.plans import report_queries

    assert plan(patch_queries.conflict_records_whole(spark, SF)).count("Relation") == 1
    # runs, rejects and files are read once each, and a block is made once
    records = plan(report_queries.conflict_records(spark, SF))
    assert records.count("Relation") == 3 and records.count("<<<<<<< DOWNSTREAM") <= 2


def test_sections_and_growth_are_counted_as_they_are_cut(spark):
    from patchlens.functions import diff

    rng = random.Random(8)
    pieces = ["diff --git a/x b/x", "x diff --git", "@@ -1 +1 @@", "+", "+a", "-", "-- a", " c", "", "\\ No newline", "++ - +"]
    given = [*("".join(rng.choice(pieces) + rng.choice(("\n", "\r\n", "\r", "\x85", " ", "")) for _ in range(rng.randint(0, 12))) for _ in range(500)), None, "", "diff --git"]
    df = spark.createDataFrame([(x,) for x in given], "text string")
    counts = diff.line_counts(F.col("text"))
    rows = df.select(F.size(diff.sections(F.col("text"))).alias("cut"), diff.section_count(F.col("text")).alias("sections"), (counts["added"] - counts["removed"]).alias("want"), diff.grown(F.col("text")).alias("grown"), F.col("text")).collect()
    assert all(r.want == r.grown and (r.text is None or r.cut == r.sections) for r in rows) and {0, 1, 2} <= {r.sections for r in rows}
    # each patch's hunks are cut out once (they were for every number)
    assert plan(patch_queries.commit_patch(spark, SF)).count("(@@ .*)") == 2

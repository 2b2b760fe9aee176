"""Commands from file to file: exact bytes, statistics, errors that leave no file."""

import json

import pytest

from loomtab.cli import main


@pytest.fixture
def run(spark, tmp_path, capsys):
    def go(data, command, *args, encoding="utf-8"):
        source, target = tmp_path / "in.csv", tmp_path / "out.csv"
        source.write_bytes(data if isinstance(data, bytes) else data.encode(encoding))
        target.unlink(missing_ok=True)
        io = ["-i", str(source)] + ([] if command == "info" else ["-o", str(target)])
        code = main([command, *io, *args], spark)
        said = capsys.readouterr()
        assert not list(tmp_path.glob("*.tmp"))
        return code, target.read_bytes().decode(encoding) if target.exists() else None, said.out, said.err

    go.dir = tmp_path
    return go


def test_mask(run):
    code, out, said, _ = run("名前,年齢\n佐藤😀,30\n,5\n", "mask", "-c", "名前")
    assert (code, out) == (0, "名前,年齢\n***,30\n,5\n")
    assert said == "処理行数: 2\nヒット行数: 1\nヒット総数: 1\n"


def test_mask_by_index_without_header_and_ragged(run):
    assert run("a,b,c\nd,ee\n", "mask", "-c", "1", "--mask-char", "xy", "--no-headers")[1] == "a,x,c\nd,xx\n"
    code, out, _, err = run("a,b,c\nd\n", "mask", "-c", "2", "--no-headers")
    assert code == 1 and out is None and "out of range" in err


def test_crlf_quotes_and_lines(run):
    assert run('a,b\r\n"x\r\ny","q""r"\r\n', "mask", "-c", "a")[1] == 'a,b\r\n****,"q""r"\r\n'
    assert run("a,b\r\nx,1\ny,2\r\n", "mask", "-c", "a")[1] == "a,b\r\n*,1\r\n*,2\r\n"


def test_shift_jis(run):
    raw = "名前,年齢\n佐藤,3\n".encode("cp932")
    assert run(raw, "mask", "-c", "名前")[:2] == (1, None)
    assert run(raw, "mask", "-c", "名前", "--input-encoding", "auto", encoding="cp932")[1] == "名前,年齢\n**,3\n"


def test_replace_one(run):
    code, out, said, _ = run("a,b\nxab,1\nabaA,2\n", "replace", "-c", "a", "--from", "a", "--to", "$1\\", "--json")
    assert out == "a,b\nx$1\\b,1\n$1\\b$1\\A,2\n"
    assert json.loads(said) == {"rows_processed": 2, "rows_changed": 2, "changes_total": 3, "per_rule": [{"id": "rule[0]", "rows_affected": 2, "matches": 3}]}
    assert run("a\nAbc\n", "replace", "--all-columns", "--from", "aB", "--to", "-", "--case-insensitive")[1] == "a\n-c\n"


def test_replace_many_without_chaining(run):
    config = run.dir / "r.toml"
    config.write_text('version=1\n[[rules]]\nfrom="未着手"\nto="作業中"\n[[rules]]\nname="x"\npattern="完+"\nreplacement=""\nregex=true\n[[rules]]\nfrom="none"\nto=""\n')
    code, out, said, _ = run("s\n未着手完完作業中\n作業中\n", "replace", "-c", "s", "--config", str(config))
    assert out == "s\n作業中作業中\n作業中\n"
    assert 'rule[1] "x": ヒット 1 行 / マッチ 1 件' in said and "rule[2]: ヒット 0 行\n" in said


@pytest.mark.parametrize("first, second, text, word", [("ab", "bc", "abc", "row 2"), ("ab", "abc", "x", "part of"), ("ab", "ab", "x", "same")])
def test_replace_collisions(run, first, second, text, word):
    config = run.dir / "r.toml"
    config.write_text(f'version=1\n[[rules]]\nfrom="{first}"\nto="1"\n[[rules]]\nname="n"\nfrom="{second}"\nto="2"\n')
    code, out, _, err = run(f"s\nq\n{text}\n", "replace", "-c", "s", "--config", str(config))
    assert code == 1 and out is None and word in err and 'rule[1] "n"' in err


def test_replace_empty_matches(run):
    assert run("s\nbaac\n", "replace", "-c", "s", "--from", "a*", "--to", "-", "--regex")[1] == "s\n-b-c-\n"


def test_flag(run):
    code, out, said, _ = run("n,m\nA,03-12\nB,x\n", "flag", "-c", "n,m", "--pattern", r"\d", "--out-col", "f")
    assert out == "n,m,f\nA,03-12,true\nB,x,false\n" and "f: ヒット 1 行" in said
    assert run("n\nA\n", "flag", "-c", "n", "--pattern", "A", "--out-col", "n")[0] == 1
    assert run("n\nA\n", "flag", "-c", "n", "--pattern", "(?=A)", "--out-col", "f")[0] == 1


def test_extract(run):
    assert run("b\nk7m80n901\nx\n", "extract", "-c", "b", "--pattern", r"\d+", "--out-col", "n", "--separator", ";")[1] == "b,n\nk7m80n901,7;80;901\nx,\n"
    assert run("b\nk=1 k\n", "extract", "-c", "b", "--pattern", "k(=1)?", "--out-col", "n")[1] == 'b,n\nk=1 k,"=1,k"\n'


def test_split(run):
    code, out, said, _ = run("n\n森 花子\n一\na b c\n", "split", "-c", "n", "--by", " ", "--out-cols", "x,y")
    assert out == "n,x,y\n森 花子,森,花子\n一,一,\na b c,a,b c\n" and "ヒット総数: 2" in said
    assert run("n\n", "split", "-c", "n", "--by", " ", "--out-cols", "x,y")[1] == "n,x,y\n"
    assert run("n\na.b\n", "split", "-c", "n", "--by", ".", "--out-cols", "x")[1] == "n,x\na.b,a.b\n"


def test_similarity(run):
    d = run.dir / "d.csv"
    d.write_text("c,a\n静岡県,静岡\n長野県,長野\n")
    assert run("id,n\n1,静岡\n2,xyz\n", "similarity", "-c", "n", "--dict", str(d))[1] == "id,n,matched_name,score\n1,静岡,静岡県,1.0000\n2,xyz,<no match>,0.0000\n"
    d.write_text("c\nさしすせそ\n")
    for algorithm, score in (("levenshtein", "0.6000"), ("damerau", "0.8000")):
        assert run("n\nさしせすそ\n", "similarity", "-c", "n", "--dict", str(d), "--algorithm", algorithm)[1].endswith(f"{score}\n")
    t = run.dir / "d.toml"
    t.write_text('version = 1\n[[entries]]\ncanonical = "AAA"\n[[entries]]\ncanonical = "BBB"\naliases = ["b"]\n')
    assert run("n\nxxx\n", "similarity", "-c", "n", "--dict", str(t), "--threshold", "0")[1] == "n,matched_name,score\nxxx,AAA,0.0000\n"
    for bad in ("c,a\n", "c,a\nx\nx\n", "c,a\nx,1\ny,1\n"):
        d.write_text(bad)
        assert run("n\nx\n", "similarity", "-c", "n", "--dict", str(d))[0] == 1


def test_convert(run):
    code, out, said, _ = run('﻿a,b\n"x,1","l\nm"\n', "convert", "--output-delimiter", "tab")
    assert out == 'a\tb\nx,1\t"l\nm"\n' and "処理行数: 2" in said
    assert run("名前\n😀\n", "convert", "--output-encoding", "shift_jis")[:2] == (1, None)
    assert run("①,東\n", "convert", "--output-encoding", "euc-jp", encoding="utf-8")[0] == 1


def test_info(run):
    said = run("a;b\r\n1;2\r\n", "info", "--json")[2]
    assert json.loads(said) == {"file": "in.csv", "size_bytes": 10, "encoding": "utf-8", "bom": False, "delimiter": ";", "quote": '"', "line_ending": "crlf", "rows": 1, "columns": 2, "headers": ["a", "b"]}
    assert "Size:        10 B (10 bytes)\nEncoding:    UTF-8 (no BOM)" in run("a;b\r\n1;2\r\n", "info")[2]


def test_dry_run_and_arguments(run):
    code, out, said, _ = run("a\nx\n", "mask", "-c", "a", "--dry-run")
    assert (code, out) == (0, None) and "処理行数: 1" in said
    assert run("a\nx\n", "mask")[0] == 1
    assert run("a\nx\n", "replace", "-c", "a", "--all-columns", "--from", "x", "--to", "y")[0] == 1
    assert run("a\nx\n", "mask", "-c", "a", "--input-encoding", "latin1")[0] == 1


def test_overlaps_fail_in_tables_and_streams(spark, tmp_path):
    from loomtab.operators import replace as R
    from loomtab.plans.operation import apply_named, statistics
    from loomtab.streaming.operations import write_stream

    literal = [R.ReplaceRule(from_="ab", to="1"), R.ReplaceRule(from_="bc", to="2")]
    for rules in (literal, [*literal, R.ReplaceRule(pattern="x+", replacement="", regex=True)]):
        op = R.replace(["s"], R.compile_rules(rules), ["s", "t"])
        good, bad = (spark.createDataFrame([(x, "y")], "s string, t string") for x in ("ab bc.ab", "xabc"))
        assert apply_named(good, op).first()["s"] == "1 2.1" and statistics(good, op).first()["changes_total"] == 3
        for run in (lambda: apply_named(bad, op).collect(), lambda: statistics(bad, op).collect()):
            with pytest.raises(Exception, match="RuntimeCollision: column s: matches overlap"):
                run()
        bad.write.mode("overwrite").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(bad.schema).parquet(str(tmp_path / "in"))
        with pytest.raises(Exception, match="RuntimeCollision"):
            write_stream(stream, op, str(tmp_path / "out"), str(tmp_path / f"check{len(rules)}")).awaitTermination(120)


def test_many_literal_rules(spark):
    import random

    from loomtab.operators import replace as R
    from loomtab.plans.operation import apply_named, statistics

    random.seed(1)
    rules = [("東", "$1"), ("ab", "\\"), ("ca", ""), ("d.", "ab"), ("^", "|")]
    op = R.replace(["s"], R.compile_rules([R.ReplaceRule(from_=a, to=b) for a, b in rules]), ["s"])
    texts = ["".join(random.choices(["東", "ab", "ca", "d.", "^", "x", "\n", "é"], k=12)) for _ in range(300)] + ["", "none"]
    texts = [t for t in texts if "cab" not in t]
    want, total = [], 0
    for t in texts:
        out, i = "", 0
        while i < len(t):
            a, b = next(((a, b) for a, b in rules if t.startswith(a, i)), (None, None))
            total += a is not None
            out, i = (out + b, i + len(a)) if a else (out + t[i], i + 1)
        want.append(out)
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r.s for r in apply_named(df, op).collect()] == want and statistics(df, op).first()["changes_total"] == total


def test_config_files(run):
    (run.dir / "dict.csv").write_text("c,a\n静岡,しずおか\n")
    configs = {
        "mask": ("columns = [\"b\", 0]\n[options]\nmask_char = \"#\"\n", "a,b\n##,###\n"),
        "flag": ("[[rules]]\ncolumns = [\"a\", \"b\"]\npattern = \"q\"\nout_col = \"f\"\ntrue_value = \"1\"\nfalse_value = \"0\"\n", "a,b,f\nxy,pqr,1\n"),
        "extract": ("[[rules]]\ncolumn = \"b\"\npattern = \"[q-r]\"\nout_col = \"e\"\nseparator = \"+\"\n", "a,b,e\nxy,pqr,q+r\n"),
        "similarity": (f"[[rules]]\ncolumn = \"a\"\ndict = \"{run.dir / 'dict.csv'}\"\nout_col = \"m\"\nscore_col = \"s\"\nalgorithm = \"dice\"\n", "a,b,m,s\nxy,pqr,<no match>,0.0000\n"),
    }
    for command, (text, want) in configs.items():
        config = run.dir / f"{command}.toml"
        config.write_text("version = 1\n" + text)
        assert run("a,b\nxy,pqr\n", command, "--config", str(config))[1] == want, command
        config.write_text(text)
        assert run("a,b\nxy,pqr\n", command, "--config", str(config))[0] == 1, command

"""Small inputs for the readers and the operators that need Persian dimension tables, with what must come of them."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from parsloom.operators.tables import new_path

Z = "‌"
#: Common verbs, past and present root.
VERBS = [
    ("رفت", "رو"), ("گفت", "گو"), ("دید", "بین"), ("کرد", "کن"), ("شد", "شو"), ("خواند", "خوان"), ("نوشت", "نویس"), ("آمد", "آ"), ("داد", "ده"), ("گرفت", "گیر"), ("ساخت", "ساز"), ("فروخت", "فروش"),
    ("خرید", "خر"), ("شناخت", "شناس"), ("دانست", "دان"), ("خواست", "خواه"), ("بود", "باش"), ("داشت", "دار"), ("توانست", "توان"), ("رسید", "رس"), ("گذاشت", "گذار"), ("پذیرفت", "پذیر"), ("یافت", "یاب"), ("پرسید", "پرس"),
]
INFORMAL_VERBS = [("توانست", "توان", "تون", False), ("گفت", "گو", "گ", True), ("خواست", "خواه", "خوا", True)]
INFORMAL_WORDS = [("واسه", "برای"), ("دیگه", "دیگر"), ("یه", "یک"), ("خونه", "خانه"), ("اون", "آن")]
LEXICON = [("کتاب", 120), ("خانه", 90), ("جمهوری", 40), ("صداوسیما", 7), ("آتشفشان", 5), ("اندیشه", 21), ("اعلام", 33), ("زمین", 60), ("برای", 800), ("زمین‌لرزه", 4), ("دیگر", 300), ("یک", 900), ("آن", 700), ("بزرگ", 80), ("به", 2000), ("مردم", 150)]


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(VERBS)], "ix int, past string, present string")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, n, []) for w, n in LEXICON], "word string, frequency bigint, pos_tags array<string>")


def informal_verbs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(INFORMAL_VERBS)], "ix int, past string, present string, informal_present string, flag boolean")


def informal_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INFORMAL_WORDS, "informal string, formal string")


_CONLL = "# c\n1\tکتاب\tکتاب\tN\tIANM\tezafe|x\n2\tعلی\tعلی\tN\tANM\t_\n3-4\tx\tx\tN\tN\t_\n4\tرا خوب\t_\tPOSTP\tPOSTP\t_\n\n1\tرفت\tرفت\tV\tACT\t_\n2\tshort\n"
_UD = "# c\n1\tکتاب\tکتاب\tNOUN\tN\tCase=Ezafe\n2\tرا\tرا\tPART\tP\t_\n\n1\tرفت\tرفت\tVERB\tV\t_\n"

#: Reader by name: the files (name, content) it reads and where below the folder it is pointed to.
FILES: dict[str, tuple[dict[str, str | bytes], str]] = {
    "arman": ({"test_a.txt": "علی B-pers\nرفت O\nlabelless\n\n\nتهران B-loc\n", "test_b.txt": "", "train_c.txt": "او O\n"}, ""),
    "ner": ({"sub/n.txt": "علی\tB-PER\nآمد\tO\n\nقم\tB-LOC"}, ""),
    "bijankhan": ({"b.txt": "#  DELM\nاولین  ADJ_SUP\nسياره  N_SING\nديده  V_PA\nشد  V_PA\n.  DELM\nبد\nاو  PRO\n*  DELM\nرفت  X\n"}, "b.txt"),
    "dadegan": ({"d.conll": _CONLL}, "d.conll"),
    "universal_dadegan": ({"u.conllu": _UD}, "u.conllu"),
    "degarbayan": ({"corpus_pair.xml": "<Pairs><Pair><PairId>1</PairId><NewsSource1>a</NewsSource1><NewsSource2>b</NewsSource2><Sentence1> یک &amp; دو </Sentence1><Sentence2>دو</Sentence2><MethodType>m</MethodType><judge>0</judge></Pair><Pair><PairId>2</PairId><Sentence1>س</Sentence1><Sentence2>ش</Sentence2><judge>-1</judge></Pair></Pairs>"}, ""),
    "faspell": ({"faspell_main.txt": "wrong\tright\tcat\nاشتباه\tاشتبا\t3\nبد\tخوب\tx\nتنها\n", "faspell_ocr.txt": "h\th\nآب\tاب\n"}, ""),
    "hamshahri": ({"1996/HAM2-960101.xml": '<C><DOC id="d1"><TITLE> عنوان </TITLE><TEXT>متن &lt;یک&gt;</TEXT><ISSUE>7</ISSUE><DATE>75/1/1</DATE><CAT name="cat.fa"><ITEM>ادب</ITEM><ITEM>هنر</ITEM></CAT></DOC></C>', "1996/HAM2-960622.xml": '<C><DOC id="broken"><TEXT>x</TEXT></DOC></C>'}, ""),
    "mirastext": ({"m.txt": "متن یک *** u *** k\n *** only\nمتن دو\n"}, "m.txt"),
    "mizan": ({"mizan_fa.txt": "یک\nدو\nسه\n", "mizan_en.txt": "one\ntwo\n"}, ""),
    "naab": ({"train-1.txt": " یک \n\nدو\n", "test-1.txt": "سه\n"}, ""),
    "plain_text": ({"p.txt": "سلام. خوبی؟\nبله!"}, "p.txt"),
    "persica": ({"p.csv": "﻿12,\nعنوان,\nمتن,\n1389/1/1,\n10:20,\nالف,\nب,\nx,\nt2,\nm2,\nd2,\nz2,\nc2,\ne2,\n99\n"}, "p.csv"),
    "peykare": ({"k/1.txt": "1 1 N N,EZ,SING کتاب\n1 1 N N,PL بچه ها\n1 1 PUNC PUNC .\n1 1 X X #\n1 1 PUNC PUNC .\n".encode("cp1256", "replace")}, ""),
    "pn_summary": ({"train.csv": "h\th\na1\tت\tم\tخ\tورزش+فوتبال\tISNA\thttp://x\t9\nbad\trow\n", "dev.csv": "h\nb1\tت\tم\tخ\tهنر\tIRNA\thttp://y\t1\n"}, ""),
    "quran": ({"q.txt": "# x\n(1:1:1:1)\tbi\tP\tPREFIX|bi+\n(1:1:1:2)\tsomi\tN\tSTEM|LEM:{som|ROOT:smw\n(1:1:2:1)\t{ll~ahi\tPN\tLEM:{ll~ah\n"}, "q.txt"),
    "sentipers": ({"s.xml": '<R><Product Title="دوربین" Type="Cam"><Opinion id="1" holder="h" value="2"><Sentence id="s1" value="1"> خوب </Sentence></Opinion><Criticism id="2" holder="g" value="-1"><Sentence id="s2" value="-1">بد</Sentence></Criticism></Product></R>'}, ""),
    "tnews": ({"t.xml": '<TNews><NEWS id="n1"><URL>http://a</URL><DATETIME>d</DATETIME><CATEGORY>c</CATEGORY><PRETITLE></PRETITLE><TITLE><![CDATA[<b>عنوان</b>]]></TITLE><POSTTITLE/><BRIEF>ب\x01ریف</BRIEF><TEXT>متن &lt;p&gt;دو&lt;/p&gt;</TEXT></NEWS>'}, ""),
    "treebank": ({"b.xml": '<T><S><w lc="N1" clitic="ezafe">کتاب</w><p><w lc="V2">رفت</w></p></S><S></S></T>'}, ""),
    "verb_valency": ({"v.txt": "بن ماضی\tبن مضارع\tپ\tع\tح\tظ\nخواند\tخوان\t-\tدرس\t-\tفا\nکم\tدو\n"}, "v.txt"),
    "wikipedia": ({"w.txt": 'junk\n<doc id="3" url="http://u" title="عنوان">\nخط یک\n\nخط دو\n</doc>\n<doc id="4" url="v" title="t">\nunended\n'}, "w.txt"),
    "text_vectors": ({"v.vec": "4 3\nکتاب 1 0 0\nدفتر 0.9 0.1 0\nکوتاه 1\nپنجره 0 0 2 9\n"}, "v.vec"),
}


FILES |= {
    "lexicon": ({"words.dat": "کتاب\t12\tN,AJ\nبد\tx\tN\nخانه\t3\tN\nکم\t1\nکتاب\t15\tN\n"}, "words.dat"),
    "verb_roots": ({"verbs.dat": "#هست\nرفت#رو\n\nبی\nدید#بین\n"}, "verbs.dat"),
    "stopwords": ({"stop.dat": "و\n در \n\nو\n"}, "stop.dat"),
    "informal_words": ({"iwords.dat": "یه یک\nواسه برای\nاینا این ها\nیه یکی\n"}, "iwords.dat"),
    "informal_verbs": ({"iverbs.dat": "بود#باش باش 1\nتوانست#توان تون 0\n"}, "iverbs.dat"),
}


def word_vectors_binary(rows: list[tuple[str, list[float]]]) -> bytes:
    return f"{len(rows)} {len(rows[0][1])}\n".encode() + b"".join(w.encode() + b" " + np.array(v, dtype="<f4").tobytes() + b"\n" for w, v in rows)


def subword_binary(rows: list[tuple[str, list[float]]], buckets: list[list[float]], minn: int = 0, maxn: int = 0, magic: int = 793712314, version: int = 12, quantized: int = 0) -> bytes:
    d = len(rows[0][1])
    args = bytearray(72)
    for at, x in ((12, d), (48, len(buckets)), (52, minn), (56, maxn)):
        struct.pack_into("<i", args, at, x)
    words = b"".join(w.encode() + b"\0" + struct.pack("<qb", 1, 0) for w, _ in rows)
    matrix = np.array([v for _, v in rows] + buckets, dtype="<f4")
    return struct.pack("<II", magic, version) + bytes(args) + struct.pack("<iiiqq", len(rows), len(rows), 0, len(rows), 0) + words + struct.pack("<bqq", quantized, *matrix.shape) + matrix.tobytes()


WORD_VECTORS = [("کتاب", [1.0, 0.0, 0.0]), ("دفتر", [0.9, 0.1, 0.0]), ("پنجره", [0.0, 0.0, 1.0])]
FILES["binary_vectors"] = ({"v.bin": word_vectors_binary(WORD_VECTORS)}, "v.bin")
FILES["subword_model"] = ({"m.bin": subword_binary([("ایران", [3.0, 4.0, 0.0]), ("تهران", [0.0, 2.0, 0.0])], [[1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], 3, 3)}, "m.bin")


def put(spark: SparkSession, name: str) -> str:
    """Write a reader's files to the shared folder (spark.checkpoint.dir, else a temporary one) and give the path to read."""
    files, at = FILES[name]
    folder = new_path(spark, "samples")
    jvm = spark.sparkContext._jvm
    for file, content in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
        out.close()
    return f"{folder}/{at}" if at else folder

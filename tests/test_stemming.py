from pyspark.sql import functions as F

from docquarry.functions.stemming import STOPWORDS, stem, stemmed

# The published sample of words and their stems.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee
knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit
knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()
RULES = {"dying": "die", "news": "news", "skies": "sky", "ties": "tie", "cries": "cri", "gas": "gas", "kiwis": "kiwi", "hoping": "hope", "hopping": "hop", "luxuriated": "luxuri", "rational": "ration", "generously": "generous", "arsenal": "arsenal", "exceed": "exceed", "bed": "bed", "by": "by", "é": "é"}


def test_the_published_sample():
    assert {w: stem(w) for w in SAMPLE[::2]} == dict(zip(SAMPLE[::2], SAMPLE[1::2]))
    assert {w: stem(w) for w in RULES} == RULES and len(STOPWORDS) == 127


def test_columns_keep_their_places(spark):
    rows = spark.createDataFrame([(["running", "the", "dogs"],), ([],), (None,), (["the"],)], "w array<string>").coalesce(1)
    assert [r.s for r in rows.select(stemmed(F.col("w")).alias("s")).collect()] == [["run", "", "dog"], [], None, [""]]

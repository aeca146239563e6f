import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import sentences as S

TEXTS = [
    "See U.S. Pat. No. 3,186,508 to Dr. Fid et al. for a valve.| At 2:07 a.m. the carrier was replaced.| pH values hold.|",
    "ABSTRACT|\n(The valve 26 may be omitted.)|\n\nAccording to [Formula 6]\nη = (T21 − T□) / ?? ,\nthe guide loses 100.8 %.|",
    "What is claimed is:|\n1. A sensor comprising:\na clamp. Or\na spring.|\n2. The sensor of claim 1, e.g., a plate.|",
    'The operator asked, "Which one?" before opening.| The display shows "Stop!" and halts.| This is the "X mode."| Next|\n\nopen end|',
    "[0001] Gemäß Nr. 18 nach Abs. 9 wird z. B. Stahl genutzt.| Am 12. Lager war Verschleiß.| Dieser Zustand heißt „X-Betrieb.“| Ende usw.| Die Anzeige meldet „Halt!“ und stoppt.|",
    "【要約】|\n（密封電極98bは省略してもよい。）|表示部に「停止。」と表示され、止まる。|まだ156.1℃か？|\n\n【請求項1】\n軸と、\n板。|\n【請求項2】\n前記。|",
    "摘要|\n操作者问：“是哪个轴？”然后打开。|其中，F=2.8·k。|",
    "L'écran affiche « Arrêt ! » et la plaque.| On emploie, p. ex., laiton, etc.| Selon M. X, c'est vrai.|",
    "डॉ. X के अनुसार 1.2 % हानि है।| क्या है?|",
    "Пригодны, напр., сталь и т. д.| В 2019 г. линза была заменена.| По данным А. Б. Х это так.|",
    "Wait...| Then (see a. B is c) it ends.|",
]


@pytest.mark.parametrize("marked", TEXTS)
def test_units(marked):
    text, want = "", []
    for part in marked.split("|")[:-1]:
        text += part
        want.append(len(text))
    got = S.unit_ends([text])[0].tolist()
    assert [text[a:b] for a, b in zip([0, *got], got)] == [text[a:b] for a, b in zip([0, *want], want)]


def test_prefix_scan_equals_sequential():
    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 1000, 5000):
        classes = np.array([rng.randrange(7) for _ in range(n)], dtype=np.uint8)
        state, want = 0, []
        for c in classes:
            want.append(state)
            state = int(S._NEXT[c, state])
        assert S.entry_states(classes).tolist() == want


def test_table(spark):
    long = "One is here. " * 20_000
    df = spark.createDataFrame([(1, "A b. C d.", 5), (1, "A b. C d.", 5), (2, None, 5), (3, "", 5), (4, " \n ", 5), (5, long, 5)], "doc_id long, text string, end_char int")
    rows = S.sentence_units(df).collect()
    assert sorted(r.end_char for r in rows if r.doc_id == 1) == [4, 4, 9, 9]
    assert sum(r.doc_id == 5 for r in rows) == 20_000 and max(r.end_char for r in rows) == len(long.rstrip())
    assert {r.doc_id for r in rows} == {1, 5}
    assert S.sentence_units(df.where(F.lit(False))).count() == 0


def test_pieces_of_a_long_text_compose():
    import random

    import numpy as np

    rng = random.Random(9)
    blocks = ["ABSTRACT", "A valve, cf. Fig. 3, opens. It closes (at 20.5 bar).", "1. A device comprising\na) a rod; and\nb) a plate.", "2. The device of claim 1, wherein it turns.", "3. The device of claim 2.\n4. A kit.", "12. No claim here", "1. Anew, a method.", "[0007] The rod is long. It bends", "阀门打开。关闭。", "7. The device of claim 2."]
    for n in (1, 3, 12, 60):
        for _ in range(40):
            text = "\n\n".join(rng.choice(blocks) for _ in range(n)) + rng.choice(["", "\n\n", " \n \n"])
            whole = S._events(text)[:2]
            for size in (1, 20, 90, 1000):
                got = S.events(text, size)
                e = [np.array(x[1])[S._EMITS[np.array(x[0], np.uint8), S.entry_states(np.array(x[0], np.uint8))]] for x in (whole, got)]
                assert sorted(set(e[0].tolist()) - {0}) == sorted(set(e[1].tolist()) - {0})

"""Every script has a band that keeps prose and rejects junk."""
import random

import public_tokenizers as P
import pytest

from gridlens.llm import quality as Q

PROSE = {
    "ARABIC": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء لكل إنسان حق التمتع بكافة الحقوق والحريات الواردة في هذا الإعلان دون أي تمييز",
    "HEBREW": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם כולם חוננו בתבונה ובמצפון לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחוה כל אדם זכאי לזכויות ולחרויות שנקבעו בהכרזה זו ללא הפליה",
    "DEVANAGARI": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए",
    "HANGUL": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다 모든 사람은 어떤 종류의 차별도 없이",
    "HIRAGANA": "すべての にんげんは うまれながらにして じゆうであり かつ そんげんと けんりとに ついて びょうどうである にんげんは りせいと りょうしんとを さずけられており たがいに どうほうの せいしんを もって",
    "KATAKANA": "コンピュータ プログラム データ ネットワーク インターネット サービス システム ソフトウェア ユーザー アプリケーション テクノロジー ビジネス マネジメント ニュース スポーツ レストラン ホテル",
    "CJK": "人人生而自由 在尊严和权利上一律平等 他们赋有理性和良心 并应以兄弟关系的精神相对待 人人有资格享有本宣言所载的一切权利和自由 不分种族 肤色 性别 语言 宗教 政治或其他见解",
    "THAI": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์ และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ",
    "ARMENIAN": "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով Նրանք ունեն բանականություն ու խիղճ և միմյանց պետք է եղբայրաբար վերաբերվեն",
    "GEORGIAN": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით",
    "TAMIL": "மனிதப் பிறிவியினர் சகலரும் சுதந்திரமாகவே பிறக்கின்றனர் அவர்கள் மதிப்பிலும் உரிமைகளிலும் சமமானவர்கள்",
    "BENGALI": "সমস্ত মানুষ স্বাধীনভাবে সমান মর্যাদা এবং অধিকার নিয়ে জন্মগ্রহণ করে তাঁদের বিবেক এবং বুদ্ধি আছে",
}
#: code points that junk is drawn from
JUNK = {"ARABIC": (0x620, 0x6D4), "DEVANAGARI": (0x904, 0x93A), "HANGUL": (0xAC00, 0xD7A4), "HIRAGANA": (0x3041, 0x3097),
        "KATAKANA": (0x30A1, 0x30FB), "CJK": (0x3400, 0x9FFF), "OTHER": (0x1D400, 0x1D454)}


@pytest.fixture(scope="module")
def fertility():
    return Q.Fertility(P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.PATTERN)


def test_every_script_has_a_band():
    assert set(Q.SCRIPTS) | {"OTHER", "NONE"} <= set(Q.BANDS)


@pytest.mark.parametrize("name", sorted(PROSE))
def test_prose_stays(fertility, name):
    words = PROSE[name].encode().split()
    m = fertility.measure(words)
    assert m[3] == (name if name in Q.SCRIPTS else "OTHER")
    assert Q.in_band(m, None, Q.BANDS), m
    rng = random.Random(1)  # a long text of few words: less entropy than any real one of its length
    m = fertility.measure([rng.choice(words) for _ in range(3000)])
    assert Q.in_band(m, "xx", Q.BANDS), m


@pytest.mark.parametrize("name", sorted(JUNK))
def test_junk_goes(fertility, name):
    rng = random.Random(name)
    text = " ".join("".join(chr(rng.randrange(*JUNK[name])) for _ in range(rng.randint(2, 9))) for _ in range(300))
    row = Q.verdict(text, None, fertility, Q.BANDS)
    assert not row[5] and row[-1] == name
    assert not row[6], row


@pytest.mark.parametrize("wrong", ["cp1256", "gbk", "cp949", "shift_jis"])
def test_mojibake_goes(fertility, wrong):
    for name in ("ARABIC", "CJK"):
        words = PROSE[name].encode().decode(wrong, "replace").encode().split()
        assert not Q.in_band(fertility.measure(words), None, Q.BANDS), (name, wrong)

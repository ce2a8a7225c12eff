"""Column functions on what a sentence says: where it belongs, whether it is about the work, what is wanted, of what."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sections of a notice by the words that tell them, the first that fits.
SECTIONS = (
    ("采购对象", "本次采购|采购对象|采购内容"),
    ("采购范围", "招标范围|采购范围|施工范围|工程范围"),
    ("工程量", "工程量|数量|规格|型号"),
    ("施工规模", "建设规模|工程规模|项目概况|建设内容|主要内容|工程内容"),
    ("施工方法", "施工方法|施工工法|盾构|顶管施工|泥水平衡顶管|预制梁场|架梁"),
    ("设计正文", "初步设计|施工图|设计文件|结构形式|桥梁上部结构|梁型"),
)
BODY, TITLE = "公告正文", "项目名称"
#: Sections in which a product named is a product meant.
MEANT = ("项目名称", "采购对象", "采购范围", "施工内容", "施工规模", "工程量", "施工方法", "设计正文", "附件设计正文")
#: What isn't about the work, what is left out of it, and words of works.
BESIDE = "投标人资格|资格要求|企业资质|资质要求|类似业绩|历史业绩|人员要求|项目经理|操作手册|招标代理|代理机构|中标候选人单位|中标人[:：]?|施工单位[:：]?|有限责任公司|有限公司|集团公司|研究院|咨询公司|工程除外|专业除外"
LEFT_OUT = "(?:轨道交通|隧道|水利工程|桥梁工程)[^。；;]{0,12}(?:除外|不适用)"
COMPANY = "^.*?(?:有限责任公司|有限公司|集团公司|研究院|咨询公司)"
WORKS = "工程|施工|建设|区间|结构|道路|桥梁|隧道|轨道|水利|泵站|护岸|管廊|通道"
#: Intents in the order in which they are looked for.
INTENTS = {
    "采购": "采购|招采|供应|供货|购置|询价",
    "生产": "生产|预制|加工|制造",
    "安装": "安装|吊装|架设|架梁",
    "施工使用": "采用|使用|施工|建设|实施",
    "检测维护": "检测|监测|维修|维护|修复|病害|破损",
    "既有设施": "既有|原有|现状|已建|存量",
}
#: Actions in the order of their preference.
ACTIONS = ("采购", "供应", "供货", "购置", "询价", "租赁", "出租", "生产", "加工", "制造", "安装", "吊装", "架设", "架梁", "预制", "专业分包", "劳务分包", "招标", "服务")
#: What a subject may begin with and does without.
OPENING = "^(?:关于|本次|本标段|本工程|招标范围(?:为|包括)?|采购内容(?:为|包括)?|招标内容(?:为|包括)?|采购对象(?:为|包括)?|工程内容(?:为|包括)?|项目名称[:：]?|项目)?"


def section(location: Column, sentence: Column) -> Column:
    """Where a sentence belongs: a sentence of the body to the section its words tell, all others where they stand."""
    out = F.when(location != BODY, location)
    for name, words in SECTIONS:
        out = out.when(sentence.rlike(words), name)
    return out.otherwise(location)


def about_works(location: Column, sentence: Column, words: list[str], direct: bool = False) -> Column:
    """Whether a sentence that names a word speaks of the work: nothing beside it, and a telling section, direct evidence or a word of works.

    In a title what stands before the end of a company's name doesn't count.
    """
    text = F.when(location == TITLE, F.regexp_replace(sentence, COMPANY, "")).otherwise(sentence)
    named = F.lit(False)
    for w in words:
        hit = F.lower(text).contains(w.lower())
        named = named | (hit & ~text.rlike("码头(?:镇|村|乡|街道|社区)") if w == "码头" else hit)
    meant = location.isin(*MEANT) | F.lit(direct) | sentence.rlike(WORKS)
    return F.coalesce(~text.rlike(BESIDE) & ~text.rlike(LEFT_OUT) & named & meant, F.lit(False))


def intent(text: Column, other: str) -> Column:
    out = None
    for name, words in INTENTS.items():
        hit = F.coalesce(text.rlike(words), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def subject(text: Column) -> Column:
    """What the preferred action of a text is done to: what stands before it in its sentence, else what follows; empty for none.

    Of a text with several actions the one that comes first in ACTIONS counts, at its first place.
    """
    before = after = None
    for action in ACTIONS:
        at = F.instr(text, action)
        left, right = F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(action), F.length(text))
        before = F.when(at > 0, left) if before is None else before.when(at > 0, left)
        after = F.when(at > 0, right) if after is None else after.when(at > 0, right)
    marks = "[。！？；;：:]"
    left = F.btrim(F.regexp_replace(before, f"(?s)^.*{marks}", ""), F.lit(" ，,（("))
    left = F.regexp_replace(left, "(?s)^.*项目", "")
    right = F.btrim(F.regexp_replace(after, f"(?s){marks}.*$", ""), F.lit(" ，,）)"))
    found = F.btrim(F.regexp_replace(F.when(left != "", left).otherwise(right), OPENING, ""), F.lit(" ：:，,"))
    return F.coalesce(F.when(F.length(found).between(2, 80), found), F.lit(""))


def confirmed_scope(positive: Column, negative: Column, pattern: str) -> Column:
    """Whether a product stays in scope: nothing speaks against it, or a sentence for it confirms it. positive, negative: array<string>."""
    return (F.size(negative) == 0) | F.exists(positive, lambda x: x.rlike(pattern))

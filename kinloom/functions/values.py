"""Word lists and patterns that results depend on."""

from __future__ import annotations

#: Titles that several persons bear, so they never identify one.
AMBIGUOUS_TITLES = [
    "太宗", "太祖", "世宗", "高祖", "中宗", "明宗", "穆宗", "庄宗", "文宗", "武宗", "宣宗", "哀帝", "废帝", "少帝", "末帝", "皇帝", "天子", "新天子", "大宋天子", "大周皇帝", "皇太子", "太子", "皇太弟",
    "晋王", "秦王", "齐王", "赵王", "魏王", "楚王", "吴王", "蜀王", "梁王", "燕王", "汉王", "周王", "宋王", "鲁王", "皇后", "太后", "太妃", "贵妃", "淑妃", "贤妃", "世子", "长子", "次子", "三子",
    "老大", "老二", "老三", "老四", "先王", "先帝", "宰相", "枢密使", "节度使", "刺史", "侍中", "唐主", "梁主", "晋主", "汉主", "周主", "蜀主", "契丹主", "辽主", "吴主", "伶人", "优伶", "伶伦",
    "住持和尚", "法师",
]

#: Words of events that may follow a person's death.
MEMORIAL_KEYWORDS = ["追封", "追赠", "追谥", "祭", "葬", "陵", "安葬", "遗命", "遗诏", "庙号", "谥号"]

#: Edge types of families and of succession.
FAMILY_TYPES = ("FATHER_OF", "ADOPTED_SON", "SPOUSE", "SIBLING")
SUCCESSION_TYPES = ("REPLACED", "SUCCEEDED")
PARTICIPATED, FOUNDED, OCCURRED = "PARTICIPATED_IN", "FOUNDED", "OCCURRED_AT"
DEFAULT_EDGE_ROLE, OTHER_ROLE = "参与者", "其他"

#: Labels of edge types.
RELATION_LABELS = {
    "FATHER_OF": "父→子", "MOTHER_OF": "母→子", "ADOPTED_SON": "义父→义子", "SPOUSE": "夫妻", "SIBLING": "兄弟", "BETRAYED": "背叛", "KILLED": "杀害",
    "REPLACED": "篡位", "SERVED": "效力", "COMMANDED": "统帅", "SUBORDINATE": "臣属", "ADVISOR": "谋士", "ALLIED_WITH": "结盟", "RIVAL": "敌人",
    "SURRENDERED_TO": "投降", "SUCCEEDED": "继位", "FOUNDED": "创建", "PARTICIPATED_IN": "参与", "OCCURRED_AT": "发生于", "FRIEND": "朋友",
    "GRANDFATHER_OF": "祖→孙", "GRANDMOTHER_OF": "祖母→孙", "UNCLE_OF": "叔→侄", "NEPHEW_OF": "侄→叔", "CAPTURED": "俘获", "CAPTURED_BY": "被俘",
    "SUPPORTED": "支持", "DEFEATED": "击败", "DEFEATED_BY": "被击败", "APPOINTED": "任命", "SAVED": "救助", "LOYAL_TO": "忠于", "RULER": "统治者", "RULER_OF": "统治",
    "ATTACKED": "进攻", "PROTECTED": "庇护", "COLLEAGUE": "同僚", "LOVER": "情人", "REBELLED_AGAINST": "叛变", "SON_OF": "子→父", "SON": "子", "DESCENDANT": "后裔",
    "BROTHER": "兄弟", "RELATIVE": "亲属", "FOUNDER_OF": "创立", "TRUSTED": "信任", "INFLUENCED": "影响", "IMPRISONED": "囚禁", "ARRESTED": "逮捕",
    "PUNISHED": "惩罚", "REWARDED": "赏赐", "RECOMMENDED": "举荐", "REJECTED": "拒绝", "SUSPECTED": "猜忌", "THREATENED": "威胁", "FEARED": "畏惧",
    "RESPECTED": "敬重", "INSULTED": "侮辱", "GOVERNED": "治理", "GOVERNOR": "治理", "GOVERNOR_OF": "治理", "BUILT": "建造", "CONQUERED": "征服", "DEFENDED": "防御",
    "SURRENDERED": "投降", "GRANTED_TITLE": "授爵", "RENAMED": "赐名", "SENT": "派遣", "HOLDING_HOSTAGE": "扣押人质", "HOSTAGE": "人质", "IDOL": "仰慕",
    "ADMIRER": "仰慕者", "ADMIRATION": "仰慕", "CLASSMATE": "同窗", "DIPLOMAT": "外交", "DESECRATED": "亵渎", "MOURNED": "哀悼", "PRAISED": "赞赏",
    "CRITICIZED": "批评", "WARNED": "警告", "SHELTERED": "庇护", "SHELTERED_BY": "被庇护", "OPPOSED": "反对", "SUPPORTED_BY": "被支持", "DAUGHTER_OF": "女→父",
    "PARENT_OF": "亲→子", "GRANDSON": "孙", "GRANDSON_OF": "孙→祖", "ADOPTED": "收养", "ADOPTED_GRANDSON": "养孙", "ANCESTOR_OF": "先祖→后裔", "ANCESTOR": "先祖",
    "DESCENDED_FROM": "后裔→先祖", "LEADER_OF": "首领", "TEACHER": "师", "STUDENT": "徒", "DISCIPLE": "弟子", "MENTOR": "导师", "ENEMY_OF": "敌对",
    "PROPOSED_TO": "求婚", "KILLED_BY": "被杀", "DIED_IN": "死于", "FLED_TO": "逃往", "PRECEDED": "前任", "PRECEDED_BY": "前任", "PREDECESSOR": "前任",
    "SUCCESSOR": "继任",
}

#: Headings, as patterns.
NUMERAL = r"[一二三四五六七八九十百零\d]+[章回节篇]"
VOLUMES = (r"五代十国全史[①②③④⑤⑥⑦⑧⑨⑩]", r"帝国的崩裂[：:]")
PREFACES = ("前言", "自序", "序言", "序")
WHOLE, PREFACE = "全文", "前言"
SENTENCE_ENDS = "。！？；\n"

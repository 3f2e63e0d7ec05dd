"""Word lists and tables that results depend on."""

# fixed values: forms of chapter headings, in order of preference
CHAPTER_PATTERNS = (
    "第[0-9零○Ｏ一二三四五六七八九十百千万亿]+[章回节卷篇集部]",
    "第[零○Ｏ一二三四五六七八九十百千万亿]+[章回节卷篇集部]",
    r"(?:卷|Chapter|CHAPTER|Section|SECTION)\s*[0-9零○Ｏ一二三四五六七八九十百千万亿]+",
    r"(?m)^[0-9]{3,}\s*$",
    "卷[上中下]",
    "第[零○Ｏ一二三四五六七八九十百千万亿]+[回章节]",
)
CATALOG_PATTERNS = ("(?m)^目[录錄 ]", "(?i)^CONTENTS")

# fixed values: particles of classical and modern Chinese, marks that end a classical sentence
CLASSICAL_PARTICLES = "之乎者也矣焉哉兮耶尔耳欤乃其所于以"
MODERN_PARTICLES = "的了着过把被这那吧吗呢啊啦嘛"
CLASSICAL_ENDS = ("也。", "矣。", "焉。", "哉。", "乎。", "耶。", "耳。", "欤。", "兮。", "也！", "乎！", "哉！")

# fixed values: delimiters of the midpoint splitter (text, kept with the left part, name), in order of preference
SPLIT_DELIMITERS = (
    ("\n\n", True, "paragraph"), ("\n", True, "line"), ("。", True, "sentence_zh"), ("！", True, "exclamation"),
    ("？", True, "question_zh"), (".\n", True, "sentence_en"), ('。"', True, "quote_zh"), ("。』", True, "quote_tw"),
    ("　", False, "ideographic_space"), ("，", False, "comma_zh"), (", ", False, "comma_en"), (" ", False, "word"),
)

# fixed values: titles that end a name
ENTITY_SUFFIXES = (
    "小姐", "先生", "老人", "师父", "师傅", "公子", "姑娘", "夫人", "太太", "老爷", "少爷", "娘娘", "皇后", "皇上", "陛下",
    "大王", "将军", "元帅", "大人", "员外", "管家", "丫鬟", "侍女", "书童", "道士", "和尚", "尼姑", "妖精", "妖怪", "狐仙",
    "仙人", "神仙", "魔王", "鬼怪", "老者", "少年", "娘子", "郎君", "兄弟", "妹妹", "姐姐", "哥哥", "婆婆", "公公",
)
DIALOGUE_PATTERNS = ("([一-鿿]{2,6})[道说曰云]", "([一-鿿]{2,6})[怒笑嘆]道", "([一-鿿]{2,6})大[叫喝喊]")

# fixed values: mentions that name nobody, prefixes and surnames that make them names
GENERIC = (
    "师父", "师傅", "老师", "先生", "小姐", "姑娘", "夫人", "太太", "妾身", "老人", "老者", "老翁", "老汉", "老妇", "少年",
    "童子", "小孩", "孩子", "小厮", "丫鬟", "侍女", "仆人", "管家", "婢女", "道士", "和尚", "尼姑", "妖精", "狐仙", "皇上",
    "陛下", "大王", "将军", "元帅", "某人", "某生", "书生", "公子", "娘子",
)
TITLE_PREFIXES = ("老", "小", "大", "二", "三", "四", "五", "阿")
SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏"
MERGE_TITLES = (*TITLE_PREFIXES, "先生", "小姐", "公子")

# fixed values: verbs between two names and the relations they tell; words of events
RELATION_VERBS = ("是", "有", "叫", "称", "为", "拜", "封", "任", "娶", "嫁", "生", "养", "收", "传", "授", "赐", "封", "派", "令", "命", "率", "领", "随", "从", "属", "管", "治", "统", "辖", "居", "住", "在", "往", "来", "入", "出")
VERB_TYPES = {"IDENTITY_AS": "是为称叫", "MENTOR_OF": "拜传授收", "FAMILY_OF": "娶嫁生", "FOLLOWS": "率领随从", "LOCATED_AT": "居住在"}
EVENT_WORDS = ("打", "战", "斗", "攻", "杀", "救", "助", "逃", "追", "访", "寻", "遇", "见", "会", "聚", "宴", "祭", "求", "请", "献")

# fixed values: words that are no keywords
STOP_WORDS = ("的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这", "他", "她", "它", "们", "那", "什么", "怎么", "为什么", "如何", "请问", "吗", "啊", "呢", "吧", "呀", "哦", "嗯")

# fixed values: words that tell the mode of a question
TRACE_WORDS = ("追踪", "时间线", "线索", "变化", "演变", "过程", "阶段", "出场", "如何成为", "关键节点", "发展", "历程", "轨迹", "出现", "沿革", "变迁")
ANALYZE_WORDS = ("分析", "人物形象", "性格", "关系", "特点", "转变", "评价", "形象", "矛盾", "互动", "羁绊", "解析")
ENRICH_WORDS = ("反哺", "修正", "补充知识库", "KnowledgePatch", "citation_fix", "证据修正", "patch")
ASK_PREFIXES = ("请", "帮我", "分析", "追踪", "梳理", "说明", "解释", "看看", "讲讲", "基于证据")
TARGET_PRONOUNS = ("他", "她", "它", "他们", "她们", "它们", "这个人", "这个人物", "该角色", "该人物", "这位", "该人")

# fixed values: claims too broad to be supported
BROAD_CLAIMS = (
    "古代百科全书", "无所不包", "涵盖一切", "最为全面", "最重要的", r"唯一[\S]{0,4}的", "毫无疑问", "毋庸置疑", "众所周知",
    "人人皆知", "公认的", "公认的", "最高的成就", "巅峰之作", "绝无仅有", "空前绝后", r"所有[\S]{0,4}都", r"没有任何[\S]{0,4}不", r"奠定了[\S]{0,4}基础",
)

# fixed values: relation types, in order
RELATION_TYPES = (
    "父子", "父女", "母子", "母女", "兄弟", "姐妹", "兄妹", "姐弟", "祖孙", "叔侄", "舅甥", "姑侄", "堂兄弟", "表兄弟",
    "连襟", "妯娌", "翁婿", "婆媳", "亲属(未指定)", "夫妻", "恋人", "未婚夫妻", "情敌", "师徒", "师生", "师叔侄", "同门",
    "传功", "好友", "知己", "结义", "邻居", "同乡", "同窗", "敌对", "仇敌", "竞争对手", "君臣", "上下级", "同僚", "盟友",
    "主仆", "雇佣", "医患", "统帅", "战友", "降将", "俘虏", "人质", "同宗", "下属", "合伙人", "债主", "恩人", "施舍",
    "买卖", "物主", "夺舍", "共生", "契约", "转世", "附身", "认识", "未知",
)
# fixed values: other words for relation types
RELATION_SYNONYMS = {
    "父亲": "父子", "爸爸": "父子", "爹": "父子", "儿子": "父子", "女儿": "父女", "母亲": "母子", "妈妈": "母子", "娘": "母子", "儿子(母)": "母子",
    "哥哥": "兄弟", "弟弟": "兄弟", "姐姐": "姐妹", "妹妹": "姐妹", "兄长": "兄弟", "弟弟(兄)": "兄弟", "姐姐(妹)": "姐妹", "妹妹(姐)": "姐妹",
    "爷爷": "祖孙", "奶奶": "祖孙", "孙子": "祖孙", "孙女": "祖孙", "外公": "祖孙", "外婆": "祖孙", "叔叔": "叔侄", "伯伯": "叔侄", "舅舅": "舅甥", "姑姑": "姑侄",
    "堂兄": "堂兄弟", "堂弟": "堂兄弟", "表兄": "表兄弟", "表弟": "表兄弟", "岳父": "翁婿", "公公": "婆媳",
    "丈夫": "夫妻", "妻子": "夫妻", "老公": "夫妻", "老婆": "夫妻", "夫君": "夫妻", "娘子": "夫妻", "男朋友": "恋人", "女朋友": "恋人", "情人": "恋人", "未婚夫": "未婚夫妻", "未婚妻": "未婚夫妻", "爱人": "夫妻",
    "老师": "师徒", "师父": "师徒", "师傅": "师徒", "徒弟": "师徒", "弟子": "师徒", "学生": "师生", "徒儿": "师徒", "师尊": "师徒",
    "朋友": "好友", "好朋友": "好友", "挚友": "好友", "同学": "同窗", "同门师兄": "同门", "同门师弟": "同门", "师兄": "同门", "师弟": "同门", "师姐": "同门", "师妹": "同门", "义兄": "结义", "义弟": "结义", "结拜兄弟": "结义", "结拜": "结义",
    "敌人": "敌对", "仇人": "仇敌", "死敌": "仇敌", "对手": "竞争对手", "死对头": "敌对", "宿敌": "仇敌",
    "皇帝": "君臣", "臣子": "君臣", "主公": "主仆", "主人": "主仆", "仆人": "主仆", "奴婢": "主仆", "侍卫": "主仆", "上级": "上下级", "下属": "上下级", "上司": "上下级", "部下": "上下级", "同事": "同僚",
    "将军": "统帅", "士兵": "统帅", "主帅": "统帅",
    "恩公": "恩人", "救命恩人": "恩人", "债主(经济)": "债主", "欠债": "债主",
    "主宠": "契约", "灵兽契约": "契约",
}
# fixed values: any of these characters tells this type, in order; with a second set, that type instead
RELATION_HINTS = (("师徒传", "师徒"), ("父母子女", "亲属(未指定)", "夫妻", "夫妻"), ("兄弟", "兄弟"), ("姐妹", "姐妹"), ("友朋", "好友"), ("敌仇", "仇敌"), ("君臣", "君臣"), ("主仆", "主仆"), ("夫妻婚", "夫妻"), ("恋爱", "恋人"), ("同", "同门"), ("盟", "盟友"))

# fixed values: event types, in order
EVENT_TYPES = (
    "登基", "即位", "禅让", "废立", "篡位", "立储", "封王", "封后", "出征", "凯旋", "战败", "投降", "结盟", "背叛", "议和",
    "缔结婚约", "大婚", "纳妾", "和亲", "比武", "科举", "上任", "罢官", "升迁", "流放", "谋反", "刺杀", "政变", "出逃", "隐居",
    "寻访", "拜师", "收徒", "传功", "修炼", "渡劫", "突破", "炼器", "炼丹", "寻宝", "夺宝", "献宝", "铸剑", "结义", "复仇",
    "报恩", "誓言", "祭祀", "占卜", "预言", "天象", "灾难", "瘟疫", "旱灾", "水灾", "地震", "招安", "剿匪", "巡游", "赐婚",
    "使节", "朝贡", "会盟", "借兵", "劝降", "审问", "刑讯", "越狱", "劫法场", "探监", "行刺", "暗杀", "毒杀", "自尽", "殉情",
    "殉国", "战死", "病逝", "寿终正寝", "谋杀", "诛九族", "满门抄斩", "抄家", "贬为庶人", "入狱", "赦免", "起义", "起兵", "平叛",
    "招兵", "练兵", "阅兵",
)
# fixed values: other words for event types
EVENT_SYNONYMS = {
    "登基": ("即位", "登基大典", "登极", "践祚", "御极"), "驾崩": ("病逝", "驾崩", "龙驭上宾"), "禅让": ("让位", "逊位", "退位"),
    "篡位": ("篡权", "夺位", "篡夺"), "大婚": ("成亲", "结婚", "完婚", "婚娶"), "缔结婚约": ("定亲", "订婚", "下聘", "纳采"),
    "战死": ("阵亡", "殉职", "捐躯"), "自尽": ("自杀", "自刎", "上吊", "投井", "服毒"), "出征": ("出师", "征讨", "伐"),
    "复仇": ("报仇", "雪恨", "报"), "修炼": ("修行", "修练", "练功", "打坐"), "拜师": ("拜", "投师", "师从"),
    "结义": ("结拜", "义结金兰", "八拜之交"), "科举": ("应试", "赶考", "赴考", "入试"), "流放": ("发配", "充军", "贬谪"),
    "刺杀": ("行刺", "暗刺"), "谋反": ("造反", "反叛", "叛乱"), "收徒": ("纳徒", "收弟子"), "突破": ("晋级", "进阶", "破境"),
}

# fixed values: patch types by risk; sources that may have id 0; evidence and source names of old answers
HIGH_RISK = ("alias_add", "alias_block", "entity_split", "entity_merge")
CRITICAL = ("entity_split", "entity_merge")
ZERO_ID_SOURCES = ("entity", "relation", "event", "citation", "chapter_fact")
EVIDENCE_LEVELS = {"EXACT": "DIRECT", "DIRECT": "DIRECT", "NEAR": "NEAR", "INFERRED": "INFERRED"}
SOURCE_TYPES = {"entity_profile": "entity", "relation_fact": "relation", "chapter_fact": "chapter_fact", "chunk": "chunk", "relation": "relation", "event": "event", "entity": "entity", "citation": "citation"}

# What an answer is cleaned of, as patterns and what stands in their place, in order.
POLISH_TAGS = ((r"(?is)<cite\b[^>]*>.*?</cite>", ""), (r"(?i)<cite\b[^>]*/?>", ""))
POLISH_IDS = ((r"\[chunk_\d+\]", ""), (r"\brun_\d+\b", ""), (r"\bid[:：]\s*\d+", ""), (r"\bchunk\s*#?\s*\d+\b", ""))
POLISH_MARKS = (
    ("。{2,}", "。"),
    ("？{2,}", "？"),
    ("！{2,}", "！"),
    ("[；;][。.]", "。"),
    ("[，,][。.]", "。"),
    ("[。.]，", "。"),
    (" {2,}", " "),
    (r"\n{3,}", "\n\n"),
    (r" \n", "\n"),
    (r"\n ", "\n"),
    (r"^\s+|\s+$", ""),
)
POLISH_END = ((r"[。，；：、？！.,;:!? \t\n\r]+$", ""),)

# fixed values: marks between the names of a target, the word that asks for relations, words that are no part of a name
NAME_SEPARATORS = ("和", "与", "、", ",", "，", "/", "|", ";", "；")
RELATION_WORD = "关系"
TARGET_NOISE = ("追踪", "分析", "关系", "变化", "之间", "的", "在西游记中", "线索")

"""Word lists that the page and dialogue rules take as an argument."""

from __future__ import annotations

from dataclasses import dataclass, field

# The lists and labels below are data that results depend on.
POLICY_SIGNALS = [
    "禁寄", "限寄", "规则", "条款", "协议", "理赔", "赔付", "保价", "保险", "声明价值", "清关", "海关", "危险品", "锂电池", "冷链", "包装",
    "产品介绍", "产品服务", "时限", "资费", "收费", "费用", "承诺服务", "服务范围", "寄件须知", "prohibited", "restricted", "terms", "liability",
    "claim", "dangerous goods", "customs",
]
NOISE_HINTS = [
    "登录", "注册", "搜索", "首页", "购物车", "立即下单", "个人中心", "login", "register", "sign in", "track", "联系我们", "关于我们", "新闻中心",
    "加入我们", "个人服务", "企业服务", "运单查询", "网点查询", "价格时效", "快递服务", "快运服务", "解决方案", "customer service", "contact us",
    "help & support", "our company", "careers", "support", "locations",
]
HARD_TITLES = [
    "条款", "协议", "禁寄", "限寄", "须知", "规范", "标准", "restricted", "prohibited", "dangerous goods", "hazmat", "customs", "claim",
    "liability", "赔付", "理赔", "保价",
]
MENU_TOKENS = [
    "首页", "产品与服务", "个人服务", "企业服务", "在线寄件", "运单查询", "网点查询", "价格时效", "登录", "注册", "home", "services", "support",
    "menu", "contact", "locations",
]
GENERIC_CATEGORY = "服务条款"
CATEGORIES = {
    "禁限寄": ["禁寄", "限寄", "禁止寄递", "违禁品"],
    "危险品": ["危险品", "危险货物", "锂电池", "易燃", "腐蚀"],
    "冷链": ["冷链", "冷藏", "冷冻", "温控", "干冰"],
    "国际清关": ["清关", "报关", "海关", "商业发票", "关税"],
    "邮寄保险": ["保险", "保价", "声明价值", "liability"],
    "保价赔付": ["赔付", "理赔", "索赔", "赔偿", "免责条款"],
    "服务条款": ["服务条款", "使用条款", "terms", "conditions", "agreement", "协议"],
    "包装要求": ["包装要求", "包装规范", "包装须知", "packaging"],
    "产品服务": ["产品介绍", "产品服务", "产品范围", "承诺服务", "开办范围"],
    "时限标准": ["时限", "时效", "当日送达", "次日递", "承诺服务"],
    "资费规则": ["资费", "收费", "费用", "价格", "报价"],
}
INSURANCE_TERMS = ["保价", "声明价值", "shipment insurance", "declared value", "liability", "claim"]
WAF_MARKERS = ["访问的url有可能对网站造成安全威胁", "your request has been blocked", "potential threats to the server", "attack.jinxibei.com"]
LOGIN_MARKERS = ["个人登录", "法人/经办人登录", "用户名", "密码", "验证码", "忘记密码"]
QUOTE_MARKERS = ["报价查询", "发件人省份", "寄达国", "业务产品", "总资费", "首重资费"]
SERVICE_MARKERS = ["11183在线客服", "欢迎使用11183在线客服中心", "扫描二维码关注", "自助服务", "查邮件", "寄快递", "查时限", "查资费", "查邮编", "自提点"]
DIRECT_PATTERNS = ["你好", "您好", "谢谢", "感谢", "再见", "拜拜", "你是谁", "现在几点", "几点了", "今天几号", "今天日期", "改写", "润色", "总结"]
STRONG_KEYWORDS = [
    "清关", "报关", "海关", "赔付", "赔偿", "理赔", "投诉", "申诉", "改单", "禁寄", "限寄", "限制品", "危险品", "资费", "费用", "时限", "时效",
    "超时", "延误", "材料", "证明", "依据", "条款", "规则", "官方", "能不能寄", "是否可以", "需要准备", "多久能",
]


@dataclass(frozen=True)
class Lexicon:
    """Word lists and labels of the page gate and the question router."""

    signals: list[str] = field(default_factory=lambda: POLICY_SIGNALS)
    noise: list[str] = field(default_factory=lambda: NOISE_HINTS)
    hard_titles: list[str] = field(default_factory=lambda: HARD_TITLES)
    menu: list[str] = field(default_factory=lambda: MENU_TOKENS)
    categories: dict[str, list[str]] = field(default_factory=lambda: CATEGORIES)
    generic: str = GENERIC_CATEGORY
    insurance: list[str] = field(default_factory=lambda: INSURANCE_TERMS)
    direct: list[str] = field(default_factory=lambda: DIRECT_PATTERNS)
    strong: list[str] = field(default_factory=lambda: STRONG_KEYWORDS)


def reference_lexicon() -> Lexicon:
    """The lists for customer-service pages."""
    return Lexicon()


def fixture_lexicon() -> Lexicon:
    """Lists from the frequent words of the synthetic tables, so that every rule has rows."""
    return Lexicon(
        signals=["eriner", "erersch", "thtion", "ciónñ", "éelle", "einein", "aulich", "tiontion"],
        noise=["that", "ente", "leeau", "ciónas", "was", "ung"],
        hard_titles=["ention", "keiten", "ciónja"],
        menu=["thst", "anon", "erbe", "eauou", "rrdo", "andre", "iere", "inge", "osla"],
        categories={
            "fees": ["ererti", "eaueau"], "customs": ["blely", "einge"], "packing": ["osque", "thanha"], "terms": ["tionth", "ieux", "schei"],
        },
        generic="terms",
        insurance=["ering", "ersch", "ciónrr", "tionre"],
        direct=["thst", "eauou", "gaja"],
        strong=["thand", "erbe", "queé", "ción"],
    )

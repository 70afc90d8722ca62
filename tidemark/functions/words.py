"""Keyword tables of the text classifiers."""

# Keyword tiers of the news classifier, first matching tier decides.
PANIC = ["恐慌", "崩盘", "踩踏", "熔断", "流动性危机"]
EXCITEMENT = ["暴涨", "涨停潮", "全面爆发", "井喷", "抢筹"]
CAUTION = ["暴跌", "抛售", "利空", "外资撤离", "做空"]
BOOM = ["突破", "创新高", "超预期", "政策利好", "重大突破"]
NEGATIVE = [
    "暴跌", "崩盘", "恐慌", "抛售", "踩踏", "跌停", "熔断", "流动性危机", "债务违约", "信托暴雷", "外资撤离",
    "监管处罚", "立案调查", "退市", "st", "业绩爆雷", "利空", "做空", "减持", "解禁", "资金出逃",
]
POSITIVE = [
    "暴涨", "涨停", "大涨", "突破", "创新高", "拉升", "政策利好", "重磅利好", "重大突破", "超预期", "放量上攻",
    "资金涌入", "北向加仓",
]
NEWS_TIERS = [
    ("panic", PANIC), ("excited", EXCITEMENT), ("negative", CAUTION), ("positive", BOOM), ("negative", NEGATIVE),
    ("positive", POSITIVE),
]

# Risk keywords of announcement titles in matching order, with their labels.
RISK_LABELS = [
    ("减持", "⚠️ 减持"), ("减持计划", "⚠️ 减持计划"), ("定增", "🟡 定增"), ("非公开发行", "🟡 定增"),
    ("配股", "🟡 配股"), ("质押", "🟡 质押"), ("业绩预亏", "🔴 业绩预亏"), ("业绩预告亏损", "🔴 业绩预亏"),
    ("净利润为负", "🔴 亏损预警"), ("亏损", "🔴 亏损预警"), ("警示函", "🔴 监管警示"), ("问询函", "🟡 监管问询"),
    ("监管函", "🔴 监管警示"), ("立案", "🔴 立案调查"), ("调查", "🔴 被调查"), ("退市风险", "🔴 退市风险"),
    ("ST", "🔴 ST风险"), ("终止上市", "🔴 终止上市"), ("股份回购", "🟢 股份回购"),
]

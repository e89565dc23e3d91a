"""Fixed values shared with the modelling rules (keyword lists and
thresholds). They are data, kept here verbatim and in their natural order."""

from __future__ import annotations

# Keywords that mark an attribute as a correction (→ SCD type 1).
CORRECTION_KEYWORDS = ["更正", "修正", "笔误", "录入", "错误", "错填", "fix", "correction"]

# Keywords that mark an attribute as needing history (→ SCD type 2).
HISTORY_KEYWORDS = ["追溯", "历史", "过去", "曾经", "变更记录", "轨迹", "history", "audit", "track"]

# Business-number keywords of a degenerate dimension.
DEGENERATE_KEYWORDS = [
    "订单号", "子订单号", "支付单号", "退款单号", "发货单号", "收货单号",
    "流水号", "单号", "交易号", "合同号", "工单号", "发票号",
    "order_id", "order_no", "payment_id", "shipment_id", "ticket_no",
]

# Words that make a single process snapshot-like.
SNAPSHOT_KEYWORDS = ["库存", "余额", "账户", "在线", "状态", "持有", "存量"]

# Business-process lexicon (process → keywords), in order.
PROCESS_KEYWORDS: dict[str, list[str]] = {
    "下单": ["下单", "订购", "购买", "place order", "order", "create order", "submit order"],
    "支付": ["支付", "付款", "扣款", "收款", "pay", "payment", "checkout"],
    "发货": ["发货", "出库", "物流", "配送", "ship", "shipment", "dispatch", "fulfill"],
    "收货": ["收货", "确认收货", "签收", "receive", "delivery", "sign for"],
    "退货": ["退货", "退款", "退单", "refund", "return", "return order"],
    "评价": ["评价", "评论", "打分", "review", "rate", "comment"],
    "注册": ["注册", "开户", "激活", "register", "signup", "activate"],
    "登录": ["登录", "登出", "logout", "login", "sign in"],
    "加购": ["加购", "加入购物车", "收藏", "add to cart", "cart", "favorite", "wishlist"],
    "浏览": ["浏览", "访问", "点击", "view", "visit", "click", "browse"],
    "充值": ["充值", "提现", "recharge", "deposit", "withdraw"],
    "核销": ["核销", "使用", "use", "redeem", "consume"],
    "取消": ["取消", "撤销", "cancel", "void"],
    "改签": ["改签", "变更", "modify", "change"],
    "晋升": ["晋升", "降级", "调岗", "promote", "demote", "transfer"],
    "入库": ["入库", "上架", "inbound", "stock in"],
    "出库": ["出库", "下架", "outbound", "stock out"],
    "盘点": ["盘点", "inventory count", "stocktake"],
    "调拨": ["调拨", "transfer", "allocation"],
    "审批": ["审批", "申请", "approve", "request", "submit"],
}

# Entity words (matched case-sensitively) that lower confidence.
ENTITY_HINTS = [
    "用户", "商品", "订单", "会员", "商家", "店铺", "类目", "品牌",
    "user", "customer", "product", "item", "order", "member", "merchant",
]

# Data-domain lexicon (domain → keywords), in order; ties go to
# the earlier domain.
DOMAIN_KEYWORDS: dict[str, list[str]] = {
    "trade": ["订单", "支付", "退款", "下单", "交易", "结算", "改价", "order", "payment"],
    "traffic": ["浏览", "点击", "曝光", "搜索", "pv", "uv", "traffic", "click"],
    "user": ["用户", "注册", "登录", "会员", "留存", "激活", "user", "register", "member"],
    "item": ["商品", "类目", "品牌", "sku", "spu", "item", "product", "category"],
    "market": ["券", "优惠", "活动", "促销", "积分", "coupon", "promotion"],
    "social": ["评价", "评论", "分享", "点赞", "关注", "收藏", "review", "comment"],
    "finance": ["充值", "提现", "账单", "余额", "对账", "recharge", "wallet"],
    "logistic": ["发货", "收货", "签收", "物流", "仓库", "shipment", "delivery", "warehouse"],
    "risk": ["风控", "拦截", "告警", "risk", "fraud"],
    "content": ["文章", "视频", "直播", "内容", "发布", "content", "article", "video"],
    "service": ["客服", "工单", "售后", "服务", "service", "ticket"],
}

# Thresholds of the modelling rules.
JUNK_MAX_VALUES_PER_FLAG = 20
JUNK_MIN_FLAGS = 3
JUNK_MAX_COMBINATIONS = 10000
ZIPPER_MAX_CHANGES_PER_KEY = 100
ZIPPER_SMALL_DIMENSION = 100
MINI_MIN_ATTRIBUTES = 2
MINI_LARGE_DIMENSION = 10000
MULTIVALUE_ARRAY_MAX = 5
HIERARCHY_FLATTEN_MAX_DEPTH = 4

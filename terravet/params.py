"""Word lists, code lists, thresholds and patterns.

Each block is data that the checks must use as given to reach the right
result.  Logic lives elsewhere; nothing here is computed.
"""

# ---- fixed values: corridor box and place words --------------------------------
CORRIDOR_BBOX = {"lon_min": 116.310, "lon_max": 116.395, "lat_min": 39.935, "lat_max": 40.030}
CORRIDOR_KEYWORDS = [
    "五塔寺", "明光村", "大钟寺", "知春路", "学院路", "西土城",
    "北下关", "双清路", "清华东路", "清河", "五道口", "西直门", "四道口",
]
CITY_PREFIX = "北京市"
ADDRESS_COLUMNS = ["幼儿园地址", "地址", "区县具体地址", "geocode_query"]
NAME_COLUMNS = ["幼儿园名称", "机构名称", "充电站点标准名称", "name"]

# ---- fixed values: source discovery --------------------------------------------
TOPIC_TERMS = [
    "百年京张", "京张", "ai创新带", "ai 创新带", "人工智能创新带", "人工智能", "原点社区", "三区两翼",
    "海淀", "中关村科学城", "京张铁路遗址公园", "清华园车站", "五道口", "大钟寺", "小月河", "众智园",
    "学北园", "城市智能体", "城市大脑", "智能体", "慢行", "绿道", "滨水", "公共空间", "创新街区",
    "创新高地", "ai+", "ai +",
]
FORMAL_DOC_TERMS = [
    "公告", "通知", "政策文件", "政府公报", "规划纲要", "规划", "统计公报", "标准", "行动计划",
    "实施方案", "若干措施", "意见", "办法", "开放数据", "数据目录", "资格预审",
]
OFFICIAL_HOSTS = [
    "www.gov.cn", "www.beijing.gov.cn", "ghzrzyw.beijing.gov.cn", "fgw.beijing.gov.cn",
    "kw.beijing.gov.cn", "jxj.beijing.gov.cn", "zyk.bjhd.gov.cn", "www.bjhd.gov.cn",
    "data.beijing.gov.cn", "tjj.beijing.gov.cn", "yllhj.beijing.gov.cn", "wwj.beijing.gov.cn",
    "jtw.beijing.gov.cn", "swj.beijing.gov.cn", "cac.gov.cn", "www.cac.gov.cn",
]
OFFICIAL_SUFFIXES = [".gov.cn", ".beijing.gov.cn", ".bjhd.gov.cn"]
OPEN_DATA_HOST = "data.beijing.gov.cn"
MEDIA_HOSTS = [
    "www.people.com.cn", "people.com.cn", "www.xinhuanet.com", "xinhuanet.com",
    "www.chinanews.com.cn", "chinanews.com.cn", "www.bjd.com.cn", "bjd.com.cn",
]
INTERNATIONAL_HOSTS = [
    "www.oecd.org", "oecd.org", "unhabitat.org", "www.unhabitat.org", "www.brookings.edu",
    "brookings.edu", "gouai.cidob.org", "www.cidob.org", "cidob.org",
]
EXCLUDED_URL_PARTS = ["map.baidu", "amap.com", "qq.com/map", "google.com/maps"]
EXCLUDED_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".css", ".js", ".ico", ".mp4", ".mp3", ".zip", ".rar",
]
SEARCH_HOSTS = ["www.baidu.com", "baidu.com", "cn.bing.com", "www.bing.com"]
LOGIN_WORDS = ["javascript", "login", "sso"]
DROPPED_QUERY_PREFIXES = ["utm_", "spm", "from", "share"]
DATE_META_KEYS = [
    "article:published_time", "article:modified_time", "pubdate", "publishdate", "publish-date", "date",
    "dc.date", "dc.date.issued", "weibo:article:create_at", "articletime", "articlepubdate",
]
TITLE_META_KEYS = ["articletitle", "article:title", "og:title"]
DESCRIPTION_META_KEYS = ["description", "og:description"]
GAZETTE_WORD = "政府公报"
GAZETTE_COMPANIONS = ["规划纲要", "实施方案", "通知"]
LOGIN_TITLE_WORD = "登录"
PLAN_PERIOD_WORDS = ["2035", "十五五", "2026-2030", "2026—2030", "2026至2030"]
HERITAGE_WORDS = ["历史", "文物", "旧址", "遗址", "公园名录", "文化"]
CONSULTATION_WORD = "征求意见"
AUTHORITY_POINTS = {"A0": 48, "A1": 38, "A2": 20, "A3": 26, "X": -50}
RECENCY_POINTS = {"T0": 26, "T1": 21, "T2": 19, "T3": 10, "T4": 0}
CANDIDATE_CSV_COLUMNS = [
    "review_bucket", "score", "authority", "recency", "title", "url", "final_url", "published_date",
    "accessed_date", "content_type", "status", "topic_hits", "discovery_method", "query",
    "source_seed", "notes",
]

# ---- fixed values: source registry ----------------------------------------------
REGISTRY_ENUMS = {
    "authority_level": ["A0", "A1", "A2", "A3", "CLEARED_USER_DOCUMENT", "PROVISIONAL_REPOSITORY",
                        "OPEN_LICENSE_REFERENCE"],
    "source_kind": ["official_announcement", "official_standard", "official_open_data", "official_news",
                    "media_report", "cleared_user_document", "provisional_repository_data",
                    "open_license_reference", "international_reference"],
    "timeliness_level": ["T0", "T1", "T2", "T3", "T4", "NA"],
    "public_access_status": ["public_url", "public_local_snapshot", "cleared_for_repo",
                             "provisional_repository", "restricted_or_unknown"],
    "review_status": ["approved", "provisional", "needs_review", "rejected"],
    "usable_for_formal": ["yes", "background_only", "provisional_only", "no"],
}
REGISTRY_REQUIRED = [
    "title", "publisher", "source_kind", "url", "accessed_date", "file_type", "authority_level",
    "timeliness_level", "public_access_status", "license_summary", "review_status",
    "usable_for_formal", "allowed_uses", "prohibited_uses", "topics",
]
REGISTRY_ID_PATTERN = "^[A-Z0-9][A-Z0-9_-]+$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
INDEX_ID_PATTERN = "^[a-z0-9][a-z0-9-]{2,63}$"
INDEX_TYPES = ["brief", "boundary", "policy", "map", "culture", "industry", "news", "other"]
INDEX_STATUSES = ["confirmed-public", "public-draft", "external-public"]
INDEX_REQUIRED = ["id", "title", "type", "publisher", "published_at", "public_status", "citation",
                  "usage_note", "risk_note"]
RESTRICTED_WORDS = ["keyed_api", "userkey", "登录", "下载密码", "需登录"]
STANDARD_TITLE_WORDS = ["标准", "办法", "导则", "指南"]
ANNOUNCEMENT_TITLE_WORDS = ["公告", "资格预审"]
CATALOGUE_WORD = "数据目录"
DRAFT_LICENSE = "not reviewed: no licence is known yet"
DRAFT_PUBLISHER = "not reviewed"
DRAFT_ALLOWED = "to be judged by a reviewer"
DRAFT_ALLOWED_TOPIC = "background reading on "
DRAFT_ALLOWED_A0 = "evidence, once a reviewer has approved it"
DRAFT_PROHIBITED = [
    "evidence while it is not approved",
    "a boundary or a planning control without released official geometry",
    "an approval, a commitment or an engineering figure that it does not state",
]
DRAFT_PROHIBITED_RESTRICTED = "any use before access and licence terms are settled"
DRAFT_PROHIBITED_CONSULTATION = "a standard or policy in force: it reads like a draft for consultation"
REGISTRY_SCHEMA_VERSION = "0.1.0"

# ---- fixed values: package layout -------------------------------------------------
CANONICAL_LAYER_FILES = {
    "SITE_BOUNDARY": "site_boundary.geojson", "KEY_AREA": "key_areas.geojson",
    "LAND_USE": "land_use.geojson", "BUILDING_FOOTPRINT": "buildings.geojson",
    "ROAD_CENTERLINE": "roads.geojson", "GREEN_SPACE": "green_space.geojson",
    "PUBLIC_SPACE": "public_space.geojson", "PHASE": "phasing.geojson",
}
GEOMETRY_FILES = [
    "site_boundary.geojson", "key_areas.geojson", "land_use.geojson", "buildings.geojson",
    "roads.geojson", "green_space.geojson", "public_space.geojson", "constraints.geojson",
    "phasing.geojson",
]
PACKAGE_JSON_FILES = [
    "manifest.json", "agent.json", "metrics.json", "assumptions.json", "sources.json",
    "self_check.json", "compliance_matrix.json", "standard_matrix.json", "design_depth_matrix.json",
]
REQUIRED_PACKAGE_FILES = PACKAGE_JSON_FILES + ["geometry/" + f for f in GEOMETRY_FILES] + [
    "report/proposal.html", "report/copyright_statement.md", "drawings/a3-booklet.pdf",
    "drawings/a0-boards.pdf", "visual/index.html",
]
REPORT_FILES = ["proposal.html", "narrative.md", "copyright_statement.md"]
ASSET_EXTENSIONS = [".png", ".jpg", ".jpeg", ".webp", ".gif", ".svg"]
VISUAL_ASSET_EXTENSIONS = [".css", ".js", ".json", ".svg", ".png", ".jpg", ".jpeg", ".webp"]
PROTECTED_FILES = ["submissions-data.js", "gallery-publication.json"]
PROTECTED_PREFIXES = [".maintainer-review/", "docs/reviews/"]
MAINTAINER_FILES = ["submissions/README.md"]
LOGIN_PATTERN = "^[A-Za-z0-9-]{1,39}$"
SLUG_PATTERN = "^[a-z0-9][a-z0-9-]{2,63}$"
VERSION_PATTERN = r"^v?\d+(?:\.\d+){0,2}(?:[-+][A-Za-z0-9.-]+)?$"
CHANGELOG_TITLE = "# 方案迭代记录"
CHANGELOG_HEADING_PATTERN = r"^##\s+v?\d+(?:\.\d+){0,2}\s+-\s+\d{4}-\d{2}-\d{2}\s*$"
MAX_MARKDOWN_BYTES = 256 * 1024
MAX_JSON_BYTES = 512 * 1024
MAX_GEOJSON_BYTES = 10 * 1024 * 1024
MAX_ASSET_BYTES = 5 * 1024 * 1024
MAX_DRAWING_BYTES = 10 * 1024 * 1024
MAX_HTML_BYTES = 2 * 1024 * 1024
MAX_TOTAL_BYTES = 20 * 1024 * 1024
REQUIRED_IMAGES = [
    "assets/figures/site-overview.png", "assets/figures/land-use-structure.png",
    "assets/figures/key-areas.png", "assets/figures/mobility-bluegreen.png",
    "assets/figures/metrics-evidence.png",
]
SCAFFOLD_MARKERS = ["SCAFFOLD-DRAFT", "PARTICIPANT-DESIGN: replace"]
TEMPLATE_PLACEHOLDERS = ["your-github-login", "方案标题", "用 200-400 字说明", "请用 3-5 句话"]
REQUIRED_METADATA = ["title", "author_github", "language", "license", "summary"]
LICENSES = ["COMMUNITY-DISPLAY-ONLY", "CC-BY-4.0", "CC-BY-SA-4.0"]
TRANSLATION_HEADING = "# 中文正式译文"
MIN_BODY_CHARS = 5000
MIN_SECTION_CHARS = 280
MIN_ENGLISH_LETTERS = 2000
REQUIRED_SECTIONS = [
    "设计依据与资料清单", "三层范围工作框架", "统筹研究范围产业与未来城市研究",
    "总体设计范围城市更新与控规深度城市设计", "重点区域详细设计", "AI 创新生态、人才画像与 AI+ 场景",
    "用地、建筑规模与拆改留方案", "交通、轨道、市政与公共服务设施", "蓝绿空间、公共空间与城市风貌",
    "更新项目清单、实施政策与分期计划", "指标体系、面积复算与合规矩阵", "风险、版权与合规说明", "参考资料",
]
REQUIRED_TASK_IDS = [
    "1.3.1", "1.3.2", "1.3.3", "1.4.1", "1.4.2", "1.4.3", "1.5.1.1", "1.5.1.2", "1.5.2.1", "1.5.2.2",
    "1.5.2.3", "1.5.2.4", "1.5.2.5", "1.5.3.required", "1.5.3.1", "1.5.3.2", "1.5.3.3",
    "agent.1", "agent.2", "agent.3", "agent.4", "agent.5", "agent.6",
]
REQUIRED_DEPTH_IDS = [
    "existing_conditions_diagnosis", "three_level_scope_framework", "overall_spatial_structure",
    "land_use_layout", "development_intensity_controls", "height_massing_character",
    "retain_renovate_demolish", "traffic_rail_slow_parking", "municipal_new_infrastructure",
    "blue_green_public_space", "three_key_area_detailed_design", "renewal_project_list",
    "phasing_implementation", "metrics_recalculation", "risk_missing_data",
]
REQUIRED_STANDARD_IDS = [
    "PROJECT-OFFICIAL-ANNOUNCEMENT", "PROJECT-AGENT-OPEN-CALL-TASKBOOK", "MOHURD-URBAN-DESIGN-MEASURES",
    "MOHURD-CONTROL-DETAILED-PLANNING", "MNR-LAND-USE-CLASSIFICATION-GUIDE",
]
REQUIREMENT_ARRAYS = ["report_sections", "geojson_layers", "metrics", "drawings", "visual_sections",
                      "source_ids", "assumption_ids", "self_check_ids"]
EVIDENCE_ARRAYS = ["proposal_sections", "drawing_refs", "geometry_refs", "metric_refs", "source_ids",
                   "assumption_ids", "self_check_ids"]
RISK_DIMENSIONS = ["data_privacy", "implementation_complexity", "public_acceptance", "operations_cost",
                   "policy_uncertainty", "spatial_dispute", "technology_maturity", "equity_inclusion"]
CONCEPT_TYPES = ["node", "corridor", "area"]
PUBLIC_LEVELS = ["public", "cleared", "provisional"]
TRUSTED_BOUNDARY_SOURCES = ["official_public", "official_open_data", "user_provided_cleared"]
PROVISIONAL_BOUNDARY_SOURCES = ["agent_inferred_from_public_data", "osm", "user_provided_cleared"]
KEY_AREA_SQM = {
    "zhongzhiyuan_ai_acceleration_area": 1921000.0,
    "beijing_ai_origin_community": 1043000.0,
    "dazhongsi_ai_industry_cluster": 720000.0,
}
SCOPE_ORDER = ["coordinated_research_area", "overall_design_area", "key_detailed_design_area"]
FALLBACK_LAND_USE_CODES = [f"{n:02d}" for n in range(1, 25)]
HEIGHT_FIELDS = ["height_m", "building_height_m", "height"]

# ---- fixed values: content patterns -----------------------------------------------
HARD_RISK_PATTERNS = [
    (r"\b\d{17}[\dXx]\b", "疑似身份证号码"),
    (r"(?<!\d)1[3-9]\d{9}(?!\d)", "疑似手机号"),
    (r"(已获|已经获得).{0,12}(政府|官方).{0,12}(批准|背书|认可)", "疑似伪造官方批准或背书"),
]
SOFT_RISK_PATTERNS = [
    (r"(内部资料|内部数据|涉密|保密图件|非公开空间数据|未公开图件|绝密|机密)", "可能涉及非公开或敏感资料"),
    (r"(无需审批|保证落地|一定实施)", "可能存在不可执行承诺"),
]
REPORT_HTML_PATTERNS = [
    (r"(?i)<script\b", "script element"),
    (r"(?i)<iframe\b", "embedded frame"),
    (r"(?i)<form\b", "form"),
    (r"(?i)\bfetch\s*\(", "fetch call"),
    (r"(?i)\bXMLHttpRequest\b", "request object"),
    (r"(?i)\bWebSocket\b", "socket"),
    (r"(?i)\bsendBeacon\s*\(", "beacon"),
    (r"(?i)(?:src|href)\s*=\s*['\"]?(?:https?:)?//", "remote address"),
    (r"(?i)url\s*\(\s*['\"]?(?:https?:)?//", "remote style asset"),
]
VISUAL_HTML_PATTERNS = [
    (r"(?i)<iframe\b", "embedded frame"),
    (r"(?i)<form\b", "form"),
    (r"(?i)\bfetch\s*\(", "fetch call"),
    (r"(?i)\bXMLHttpRequest\b", "request object"),
    (r"(?i)\bWebSocket\b", "socket"),
    (r"(?i)\bEventSource\b", "event stream"),
    (r"(?i)\bsendBeacon\s*\(", "beacon"),
    (r"(?i)@import\s+url\s*\(\s*['\"]?(?:https?:)?//", "remote style import"),
    (r"(?i)url\s*\(\s*['\"]?(?:https?:)?//", "remote style asset"),
    (r"(?i)<script\b[^>]*\bsrc\s*=\s*['\"]?(?:https?:)?//", "remote script"),
    (r"(?i)<link\b[^>]*\bhref\s*=\s*['\"]?(?:https?:)?//", "remote link"),
    (r"(?i)<(?:img|source|video|audio)\b[^>]*\bsrc\s*=\s*['\"]?(?:https?:)?//", "remote media"),
]
VISUAL_TEXT_MARKERS = ["总览地图", "三层范围", "重点区域", "用地分区", "交通慢行", "蓝绿公共空间", "建筑",
                       "更新项目", "AI 场景", "核心指标", "任务覆盖", "自检状态", "来源", "假设"]
VISUAL_METRICS = ["site_area_sqm", "green_ratio", "public_space_ratio"]
CONCEPT_PAIRS = [
    ("生态保护红线", "ecological redline"), ("永久基本农田", "permanent basic farmland"),
    ("城镇开发边界", "urban development boundary"), ("三区三线", "three zones three lines"),
]
CONCEPT_DOMAIN_WORDS = ["国土空间", "territorial spatial", "three-lines-knowledge"]
STOCK_PHRASES = ["方案应", "需要进一步", "应统筹考虑", "应加强", "应结合", "需进一步", "应突出", "应注重", "建议应"]
OPERATIONS_WORDS = ["agent.6", "运营"]
FORMAL_FIELDS = ["official_boundary", "statutory_control", "engineering_conclusion"]
REQUIRED_PHRASES = ["概念建议", "参考方案", "可供专业团队深化研究"]
REJECTION_WORDS = ["身份证", "手机号", "伪造官方", "隐私", "涉密", "攻击性", "歧视"]

# ---- fixed values: advisory score ---------------------------------------------------
SCORE_DIMENSIONS = ["任务书相关性", "原创性", "AI 与城市规划创新性", "可实施性", "公共利益", "风险合规",
                    "表达完整度", "公开资料引用"]
SECTION_GROUPS = [
    ("摘要 / 设计依据", ["摘要", "设计依据"]),
    ("问题理解 / 研究范围", ["问题理解", "研究范围", "三层范围"]),
    ("核心概念 / 总体设计", ["核心概念", "总体设计", "重点区域"]),
    ("空间与产业方案", ["空间与产业", "用地", "交通", "蓝绿"]),
    ("AI 创新场景", ["AI 治理与创新场景", "AI 创新生态"]),
    ("落地路径 / 实施计划", ["落地路径", "更新项目清单", "实施政策", "分期"]),
    ("风险与合规说明", ["风险与合规", "风险、版权", "风险"]),
    ("参考资料", ["参考资料"]),
]
CONCEPT_ALIASES = ["核心概念", "总体设计", "重点区域"]
AI_ALIASES = ["AI 治理与创新场景", "AI 创新生态"]
LANDING_ALIASES = ["落地路径", "更新项目清单", "实施政策", "分期"]
RISK_ALIASES = ["风险与合规", "风险、版权", "风险"]
REFERENCE_ALIASES = ["参考资料"]
TASK_TERMS = ["百年京张", "京张", "海淀", "AI", "人工智能", "创新带", "中关村", "城市"]
ORIGINALITY_TERMS = ["概念", "机制", "模式", "体系", "网络", "平台", "社区", "场景", "环"]
AI_TERMS = ["AI", "人工智能", "智能体", "算法", "模型", "机器人", "自动驾驶", "无人", "数据"]
URBAN_TERMS = ["空间", "交通", "公共服务", "产业", "治理", "文化", "慢行", "社区", "园区"]
PHASE_TERMS = ["阶段", "试点", "近期", "中期", "远期", "个月", "年度", "0-6", "1 年", "三年"]
ACTOR_TERMS = ["政府", "企业", "高校", "社区", "居民", "维护者", "部门", "主体", "团队"]
METRIC_TERMS = ["指标", "评估", "满意度", "数量", "比例", "时长", "可衡量", "监测", "反馈"]
PUBLIC_TERMS = ["居民", "青年", "学生", "企业", "高校", "游客", "无障碍", "包容", "公共", "弱势"]
RISK_TERMS = ["公开", "非公开", "隐私", "版权", "授权", "复核", "风险", "合规", "涉密", "边界"]
MANUAL_REVIEW_TERMS = ["内部资料", "内部数据", "非公开空间数据", "未公开图件", "无需审批", "保证落地", "一定实施"]

# ---- fixed values: rubric and gates --------------------------------------------------
RUBRIC_WEIGHTS = {
    "brief_alignment": 20, "originality": 10, "ai_planning_innovation": 15,
    "implementation_feasibility": 20, "public_interest_inclusion": 10, "risk_compliance": 10,
    "expression_completeness": 15,
}
PROTECTED_SNAPSHOT_STATUSES = ["fetched_via_official_pdf_text", "fetched_manual_official", "user_provided_summary"]
TRUST_CHECKS = ["BOUNDARY_TRUST", "KEY_AREAS_TRUST"]

# ---- fixed values: parcel indicator extraction ------------------------------------------
ATTACHMENT_PATTERNS = [
    ("dghy", ["供地项目“多规合一”", "供地审核意见函", "“多规合一”协同平台审核意见的函", "多规合一"]),
    ("plancond", ["规划条件", "条供字", "规划意见复函", "规划意见"]),
    ("gpfile", ["挂牌文件", "招标文件", "京土整储"]),
]
PARCEL_COLUMNS = [
    "parcel_name", "parcel_code", "land_use_code", "far", "building_height_m", "building_density_pct",
    "green_ratio_pct", "land_area_sqm", "floor_area_sqm", "notice_no", "doc_no", "notice_date",
    "corridor", "source_url", "extraction_notes", "transaction_price", "winner", "transaction_date",
]
LAND_CODES = ["B4", "B23", "B2", "B1", "R2", "F1", "F2", "F3", "A33", "S32"]
DOC_NO_PATTERN = r"京规自（海）供审函[〔\[](\d{4})[〕\]]\s*(\d+)\s*号"
DOC_NO_OLD_PATTERN = r"(\d{4})\s*规\s*土\s*[(（(]\s*海\s*[)）)]\s*条\s*[供侗]\s*字\s*(\d+)\s*号"
NOTICE_NO_PATTERN = r"京土(?:整)?储(?:挂|招)[(（]海[)）]\s*[〔\[](\d{4})[〕\]]\s*(\d+)\s*号"
NOTICE_DATE_PATTERN = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
PLOT_CODE_PATTERN = r"[Hh][Dd][0OoPp0-9]{1,5}[=\-]?\s*\d{3,4}[=\-<>]?\s*<?\d{3,4}"
PLOT_CODE_PARTS = r"[Hh][Dd][0Pp0-9]{1,4}[=\-]?\s*(\d{3,4})[=\-<>]?\s*<?(\d{3,4})"
PLOT_CODE_FALLBACK = r"(?<![\dA-Za-z])((?:18|19|20)\d{2})-[A-Z]?\d{2,3}[A-Z]?(?![\dA-Za-z])"
PLOT_ROW_PATTERN = (r"([A-J])\s*地\s*块?\s*(?:.*?用\s*地\s*)?([\d.]+)[\s|]+([\d.]+)[\s|]+([\d.]+)[\s|]+"
                    r"(\d+)[\s|]+(\d+)[\s|]+(\d+)")
HEADER_WORDS = [
    ("land", ["用地规模"]), ("h", ["控制高", "控制"]), ("far", ["容积", "容"]),
    ("floor", ["地上建筑", "地上建"]), ("green", ["绿地", "绿"]), ("density", ["建筑密"]),
]

# Labels of indicators in notices and announcements.
LABEL_PATTERNS = {
    "far": r"容积率\s*[：:]\s*([\d.]+)",
    "h": r"(?:建筑)?控制高度\s*[：:]\s*([\d.]+)",
    "density": r"建筑密度\s*[：:]\s*([\d.]+)",
    "green": r"绿地率\s*[：:]\s*[≥>]?\s*([\d.]+)\s*%",
    "land": r"用地规模\s*[：:]\s*([\d.]+)\s*平方米",
    "floor": r"地上建筑规模\s*[：:]\s*([\d.]+)\s*平方米",
}
LAND_AREA_PATTERNS = [
    r"(?:总)?用地面积\s*[：:]\s*([\d,]+(?:\.\d+)?)\s*平方米",
    r"土地面积\s*[：:]\s*([\d,]+(?:\.\d+)?)\s*平方米",
]
FLOOR_AREA_PATTERNS = [
    r"(?:总)?地上建筑规模\s*[：:]\s*([\d,]+(?:\.\d+)?)\s*平方米",
    r"建筑控制规模\s*[：:]\s*([\d,]+(?:\.\d+)?)\s*平方米",
]

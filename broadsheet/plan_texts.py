"""The project catalog and the sentences of a plan built from it."""

# Catalog of projects a plan can be requested for.
CATALOG = (
    ("epiage-skill", "epiage-skill", "https://github.com/gangchen/epiage-skill", "表观遗传年龄时钟",
     "Python 离线工具；输入 CpG beta 值；当前 README 列出 25 个时钟；代码 MIT，但 GrimAge 商业使用和第三方系数/参考数据需单独核实。",
     ("衰老时钟术语地图", "算法覆盖对比页", "研究工作流学习卡")),
    ("coinstac-brainage-fnc", "coinstac-brainage-fnc", "https://github.com/trendscenter/coinstac-brainage-fnc",
     "脑龄模型",
     "COINSTAC/Docker 多中心研究组件；输入 FNC 矩阵和年龄标签；LinearSVR；仓库未发现明确 LICENSE。",
     ("脑龄算法对比页", "联邦计算流程演示", "神经影像输入格式指南")),
    ("adna-aging-clocks", "aDNA_aging_clocks", "https://github.com/Malaevleo/aDNA_aging_clocks", "古 DNA 年龄时钟",
     "将古 DNA 甲基化 BED 映射到 Illumina CpG，再调用 pyaging 的三个时钟；需要外部 manifest；仓库未发现明确 LICENSE。",
     ("古 DNA 工作流图", "现代/古代时钟差异课", "可复现性检查清单")),
    ("pd-biomarker-challenge-scoring", "PDbiomarkerChallengeScoring",
     "https://github.com/Sage-Bionetworks/PDbiomarkerChallengeScoring", "数字生物标志物",
     "帕金森数字生物标志物 DREAM Challenge 评分代码；依赖 Synapse 数据和旧版 Python/R；不是临床诊断产品；仓库未发现明确 LICENSE。",
     ("数字标志物信号地图", "挑战赛评分解释器", "评估指标学习页")),
)

# Sentences of a plan; {name}, {goal}, {role}, {direction}, {deployment}, {idea}, {facts},
# {repository} and {source} are filled from the request and the catalog.
GOAL = "把 {name} 做成可核验的{direction}"
TITLE = "{name}：7 天{direction}改造路线"
POSITIONING = "{goal}。面向{role}，只展示公开项目事实、来源和学习路径，不处理真实生物或患者数据。"
LISTS = {
    "targetUsers": ("{role}", "AI 与生命科学学习者", "开源项目评估者"),
    "mvpFeatures": ("官方仓库事实卡与来源追踪", "输入、算法、输出、许可证和限制对比", "{idea}",
                    "研究用途与非医疗边界提示"),
    "nonGoals": ("不测算个人生物年龄", "不上传或分析 DNA、甲基化、MRI、病例和患者数据",
                 "不提供疾病诊断、治疗或临床有效性结论"),
    "recommendedStack": ("Astro", "TypeScript", "原生浏览器交互", "{deployment}"),
    "dataPlan": ("只保存官方仓库公开元数据、README 摘要、许可证状态和来源日期",
                 "使用本地结构化数据与构建时校验，不搭建自动抓取或用户数据存储",
                 "交互演示只使用明确标注的合成内容，不使用个人生物数据"),
    "implementationSteps": ("冻结项目事实、未知项和非目标", "建立经过校验的数据模型", "完成一张真实卡片的纵向切片",
                            "补充筛选、比较、详情和来源追踪", "按 {deployment} 偏好完成本地构建与验收"),
    "riskAndCompliance": ("{facts}", "许可证不明确或第三方资源条款未核实时，只展示摘要和原链接",
                          "不得把研究输出解释成个人健康、疾病或治疗结论"),
    "sourceAttribution": ("{repository}", "日报来源：{source}"),
}
DAYS = (
    ("核实事实和边界", ("来源清单", "非目标清单")),
    ("建立数据模型", ("字段定义", "数据校验")),
    ("完成首张卡片", ("独立路由", "来源链接")),
    ("补齐核心交互", ("筛选", "比较")),
    ("补齐详情和合规", ("详情视图", "风险提示")),
    ("验证质量", ("测试结果", "可访问性检查")),
    ("交付可运行 MVP", ("构建产物", "运行与限制说明")),
)
DISCLAIMER = "本路线仅用于开源项目学习与网站规划，不构成医学建议；请勿输入或上传个人健康、生物或患者数据。"

"""Rule signals and intents of prompts, from their segments.

A signal is a row of a registry: polarity, weight, the signals it aims at, patterns, and compositions of
atoms that must all begin within a span of characters and a few sentences of each other.  A registry is plain
data; a library brings its own.  Patterns of signals and atoms are this project's own short wordings of their meaning; what parts,
denies and classifies prompts are fixed values.

Prompts are exploded into parts (the whole, its segments, its sentences), so each pattern stands once in the plan
and is matched by compiled row code; what the parts show is gathered by prompt and judged by array functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import prompt as P
from tessera.functions import text as T

# What ends a sentence; what parts a prompt into segments and into contexts; a block that states how things
# are now; a line that names a target; a segment that denies that it is about what it names, and forms of two signals that are no
# denial; a segment that asks for no execution.
SENTENCE_END = "\n。.!?？；;"
SEGMENT_BREAK = r"[\n。.!?？；;]+|\b(?:and\s+then|after\s+that|then|but|however|instead)\b|然后|接着|随后|但是|不过|而是"
CONTEXT_BREAK = r"[。.!?？]+"
CURRENT_BLOCK = r"(?:^|[\n;；]|\|\|)\s*(?:current\s+live(?:\s+state)?(?:\s+follows)?|current\s+runtime|current\s+state|current|当前(?:实时|运行时|状态)?)(?:\s*(?::|：))?[\s\S]{0,360}"
LINED = r"""(?:^|[\n;；{,]\s*)["']?target["']?\s*(?::|=|\bis\b)"""
DENIED = (
    r"(?:^|[\s:：,，])(?:这|此|当前|本轮|任务)?(?:不是|并非|不属于|不涉及|无关|无需)(?:当前|本轮)?",
    r"(?:^|\s)(?:this|it|the\s+task|current\s+task)?\s*(?:is\s+not|isn't|does\s+not\s+involve|doesn't\s+involve|not\s+a)\b",
)
NO_DENIAL = {
    "control_plane_worker_divergence": r"(?:worker\s*pool|worker\s*capacity|capacity|执行容量|worker\s*容量).{0,24}(?:is\s+)?not\s+full|(?:容量未满|还有容量|有余量)",
    "dispatch_runtime_development": r"(?:改|修改)(?:的)?是\s*ai[-\s]?dispatch[^。.!?！？]{0,32}不是(?:调用|使用)",
}
NO_EXECUTION = r"(?:(?:只|仅|只是|仅仅).{0,24}(?:了解|讨论|解释|说明|分析)|(?:不要|不用|不需|无需|无须|不必|先别|暂不).{0,24}(?:执行|实现|修改|修复|运行|落地|改代码|动代码)|不(?:执行|实现|修改|修复|运行|落地|改代码|动代码)|\b(?:explain|discuss|analy[sz]e)\s+only\b|\b(?:without|do\s+not|don't|no\s+need\s+to)\s+(?:executing?|implementing?|modifying?|fixing?|running?|changing?)\b)"
#: Code points that the beginnings of a composition's atoms may span, and ends of sentences between them.
SPAN, GAP = 420, 1


@dataclass(frozen=True)
class Composition:
    atoms: tuple[str, ...]
    gap: int = GAP
    span: int = SPAN


@dataclass(frozen=True)
class Signal:
    """``kept_if`` holds patterns under which a signal counts although its words are negated; ``keeps_compositions``
    says that a whole composition does so too.  ``instead`` signals ignore their patterns: only compositions count."""

    id: str
    weight: int
    patterns: tuple[str, ...]
    targets: tuple[str, ...] = ()
    compositions: tuple[Composition, ...] = ()
    routing: bool = True
    instead: bool = False
    kept_if: tuple[str, ...] = ()
    keeps_compositions: bool = False
    terms: tuple[str, ...] = ()

    @property
    def positive(self) -> bool:
        return self.weight > 0


#: Atoms of compositions: English words, then Chinese ones.
ATOMS = {
    "legacy_fact_path": r"\b(?:legacy|compatib\w+|deprecated|shadow|(?:old|alias)\s+(?:\w+\s+)?(?:path|route|endpoint|field|reader|writer|entry|format|version|aliases|code))\w*\b|[旧老](?:路径|字段|版本|入口|接口|值)|影子|别名|兼容|双读|双写",
    "migration_complete": r"\b(?:migration|cutover|switch)\b.{0,40}\b(?:complete|completed|done|finished|over|succeeded)\b|\ball\s+(?:clients|readers|callers)\s+now\b|(?:迁移|切换).{0,20}(?:完成|结束)|已.{0,6}(?:迁|切)到",
    "no_dependent_consumer": r"\bno\b.{0,24}\b(?:client|caller|consumer|dependent|user)s?\b.{0,36}\b(?:depend|rely|use|need|left|remain)\w*\b|(?:没有|不再).{0,16}(?:依赖|调用方|消费者)",
    "retire_or_converge": r"\b(?:get\s+rid\s+of|(?:rip|strip|phase|take)\s+(?:it\s+|them\s+)?out|retir\w+|remov\w+|delet\w+|drop|decommission\w*|sunset|merge\s+into\s+one|unif\w+|converg\w+|collaps\w+)\b|删|移除|下线|清[理掉]|收[敛掉]|统一|停用|合并为",
    "single_authority": r"\b(?:single|only|one)\s+(?:\w+\s+)?(?:source|truth|authority|route|path|version)\b|\b(?:canonical|authoritative)\b|唯一|权威|真源",
    "agent_goal_container": r"\b(?:codex|agent|claude)\s+goal\b|/goal\b|\b(?:create|use|start|open)\s+(?:a\s+|the\s+)?goal\b|(?:创建|建|开).{0,6}目标|goal\s*模式",
    "direct_execution": r"\b(?:start(?:\s+working)?(?:\s+now)?|execute|run|carry\s+out|keep\s+(?:going|driving)|work\s+through)\b|开始|执行|做完|推进|跑完",
    "closure_evidence": r"\b(?:acceptance|fresh\s+evidence|post-change\s+evidence|every\s+(?:check|criterion)|proof|verified)\b|验收|证据|闭环",
    "user_output_surface": r"\b(?:console|dashboard|panel|screen|page|report|view)\b|控制台|看板|面板|页面|界面",
    "decision_first": r"\b(?:first|one\s+decision|intervene|spot\s+the|urgent\s+action|decide)\b|第一眼|先(?:看|回答|判断)|一次.{0,4}判断|下一步",
    "defer_diagnostics": r"\b(?:raw|trace|diagnostic)\w*\b.{0,60}\b(?:expand\w*|details?|drawer|collaps\w*|later|behind)\b|(?:原始|诊断|字段).{0,24}(?:折叠|展开|详情|后面)",
    "hierarchy_overload": r"\b(?:equal(?:ly)?\s+(?:visual\s+)?weight\w*|overload\w*|clutter\w*|nobody\s+can\s+(?:see|spot|find)|too\s+many)\b|堆满|看不出|层级.{0,6}(?:乱|重)|信息过载",
    "ui_product_surface": r"\b(?:screen|page|board|list\s+view|form|frontend|ui|ux)\b|页面|界面|列表|表单|看板",
    "real_service_data": r"\b(?:live|real|actual)\s+(?:\w+\s+)?(?:backend|service|api|data)\b|真实.{0,4}(?:服务|数据|接口|后端)",
    "real_user_path_validation": r"\b(?:running\s+page|user\s+path|browser)\b.{0,80}\b(?:console|network|visible|errors?|click)\w*\b|\bverify\s+the\s+visible\b|(?:浏览器|用户路径|点击).{0,40}(?:控制台|网络|验)|验到.{0,12}(?:浏览器|点击)",
    "readiness_decision": r"\b(?:ready\s+to|can\s+(?:this|the|we)\b.{0,30}\b(?:ship|merge|deploy|release)|ship|whether\b.{0,30}\b(?:merge|release|deploy|ship))\b|(?:是否|能不能|可以).{0,8}(?:发布|上线|合并|交付)",
    "delivery_layers": r"\b(?:release\s+gates?|working\s+patch|user\s+workflow|repository\s+changes?|layers?)\b|发布门|门禁|用户流程|交付层",
    "fresh_delivery_evidence": r"\b(?:latest|fresh|stale|outdated|obsolete)\b.{0,40}\b(?:evidence|smoke|test|check|edit)s?\b|\bsmoke\s+is\s+stale\b|(?:最后一次|最新|变更之后|本次变更).{0,20}(?:证据|改|验)|证据.{0,8}(?:过期|失效)",
    "failure_observation": r"\b(?:fail\w*|cannot|can't|broken|error\w*|timeout)\b|失败|报错|连不上|不通|异常",
    "tool_environment_boundary": r"\b(?:browser|harness|extension|sandbox|network|permission|session|environment|proxy)\b|浏览器|插件|扩展|网络|权限|环境|沙箱",
    "triage_across_layers": r"\b(?:distinguish|determine\s+whether|separate|which\s+layer|owns\s+the\s+(?:fault|failure)|before\s+(?:changing|editing|touching))\b|区分|先判断|哪一层|归因",
    "retrieval_symptom": r"\b(?:recall|retriev\w+|match\w*|experiences?|cards?)\b.{0,60}\b(?:leak|miss|regress|unrelated|noise|wrong)\w*\b|\bunrelated\s+(?:experiences?|cards?)\b|(?:召回|匹配|经验).{0,24}(?:误|漏|不准|噪声|串)",
    "retrieval_pipeline_stage": r"\b(?:applicability|ranking|scoring|signal|context\s+assembly|admission|top-?k|gate)\b|适用性|排序|打分|信号|准入|上下文组装",
    "retrieval_stage_diagnosis": r"\b(?:locali[sz]e|diagnose|owns\s+the\s+fault|responsible\s+stage|which\s+stage)\b|定位|诊断|哪个阶段|责任阶段",
    "source_reconciliation": r"\b(?:reconcile|precedence|disagree\w*|which\s+source\s+is|align\s+with)\b|对齐|对不上|判断哪|以谁为准",
    "requirement_design_source": r"\b(?:spec|specification|prd|requirements?|design\s+doc|acceptance\s+criteria|contract)\b|需求|设计|规格|\bac\b|口径",
    "runtime_implementation_evidence": r"\b(?:production\s+logs?|deployed|request\s+traces?|running\s+system|live\s+code|code\s+throws|feature\s+flag)\b|线上|日志|实际实现|运行时|代码",
    "trace_execution_path": r"\b(?:map|trace|follow)\b.{0,60}\b(?:flow|path|entry\s+points?|chain|call)s?\b|(?:梳理|追踪|画出).{0,16}(?:链路|入口|路径|流程)",
    "consumer_deployment_facts": r"\b(?:active|real|external|current)\s+(?:\w+\s+)?(?:consumers?|callers?|clients?)\b|\bdeployment\s+facts?\b|(?:真实|外部|当前).{0,8}(?:调用方|消费者)|部署事实",
    "final_boundary_choice": r"\bdecide\b.{0,60}\b(?:retire|migrate|remove|final|keep|boundary)\w*\b|\bfinal\s+state\b|最终态|去留|边界",
    "irreversible_operation": r"\b(?:git\s+push|force[- ]push|drop|truncat\w+|wipe|delete|restart|redeploy|deploy|top(?:ped)?\s+up)\b.{0,50}\b(?:production|prod|table|database|data|quota|release|branch|live|online)?\b|(?:删除|清空|覆盖|部署|重启).{0,16}(?:线上|生产|数据|库)|(?:线上|生产).{0,10}(?:删除|清空|部署|重启)",
    "user_imperative_authorization": r"\bplease\s+(?:deploy|push|delete|drop|restart|publish|release)\b|\b(?:i\s+(?:have\s+)?authori[sz]ed?|you\s+may|approved,?\s+go|go\s+ahead)\b|我(?:已)?授权|已批准|可以直接|帮我\s*push",
    "authorization_stop_boundary": r"\b(?:stop|pause|wait|hold|before\s+(?:acting|either|doing))\b.{0,80}\b(?:approval|authori[sz]ation|confirm\w*|permission|action)\b|\bbefore\s+acting\b|\bapproval\s+is\s+(?:still\s+)?missing\b|(?:未|没有|拿到).{0,8}(?:授权|批准|确认)|先停|再动手",
    "specific_change_review": r"\b(?:audit|review)\b.{0,40}\b(?:patch|commit|pr|change|diff)\b|\b(?:small|tiny)\s+(?:pr|patch|change)\b|(?:审|评审).{0,16}(?:改动|提交|补丁|diff)",
    "structural_complexity": r"\b(?:wrappers?|registr(?:y|ies)|factor(?:y|ies)|fallback\s+layers?|abstractions?|indirection|extra\s+layers?)\b|包装|工厂|抽象层|兜底层|间接",
    "present_justification": r"\b(?:current|real|actual)\s+(?:callers?|needs?|use)\b|\b(?:threat\s+model|leave\s+the\s+patch|keep\s+(?:only|them))\b|真实需要|当前调用|有没有必要",
    "substitute_implementation": r"\b(?:mock|fake|stub|placeholder|canned|fallback\s+report|demo\s+route|hard-?coded)\b|假数据|模拟|占位|兜底|写死",
    "prototype_exit_boundary": r"\b(?:temporary|prototype|exit\s+condition|rip\s+it\s+out|test-only|seam|until\s+the\s+real)\b|临时|原型|退出条件|过渡",
    "real_proof_boundary": r"\b(?:do\s+not\s+claim|never\s+use|not\s+evidence|real\s+delivery|production-ready|proves?\s+production|closed\s+user\s+journey)\b|不能(?:当|算|代替|证明)|不算.{0,6}(?:交付|证据)|真实交付",
    "multiple_model_reviewers": r"\b(?:gemini|claude|grok|gpt|opus)\b.{0,24}\b(?:and|,)\s*(?:gemini|claude|grok|gpt|opus)\b|\b(?:several|multiple|two|external)\s+models?\b|多模型|多个模型|外部模型",
    "independent_model_review": r"\bindependent(?:ly)?\b.{0,24}\b(?:review|inspect|audit|check)\w*\b|\b(?:review|inspect|audit)\w*\b.{0,24}\bindependent(?:ly)?\b|独立.{0,8}(?:审|评|检)",
    "review_source_bundle": r"\bgive\s+them\b|\b(?:contract|diff|logs?|sources?)\b.{0,24}\b(?:diff|logs?|contract|evidence)\b|(?:合同|契约|日志|源码|diff).{0,12}(?:一起|给)",
    "primary_adjudication": r"\b(?:reconcile\s+disagreements?|instead\s+of\s+voting|adjudicat\w+|final\s+call)\b|主裁|裁决|不(?:靠|是)投票",
    "agent_entry_rule_entity": r"\b(?:agents\.md|claude\.md|agent\s+(?:instructions|guidance|rules)|entry\s+(?:agent\s+)?(?:instructions|rules))\b|入口规则|规则文件",
    "rule_governance_intent": r"\b(?:audit|decide|reorganize|govern|recommend|relocate|belongs?)\b|治理|整理|归位|审计",
    "rule_layer_problem": r"\b(?:duplicated?|layers?|root|repository\s+rules?|project|skills?|keep,\s*remove)\b|重复|分层|层级|冗余",
    "stated_non_understanding": r"\b(?:lost\s+me|(?:do\s+not|don't|didn't)\s+(?:understand|get|follow)|(?:doesn't|does\s+not)\s+make\s+sense|jargon-?heavy|confus\w+)\b|没(?:看|听)?(?:懂|明白)|看不懂|听不懂|不明白",
    "explanation_repair_request": r"\b(?:analogy|simpler|plain(?:er)?|again|two\s+key|explain\s+(?:it\s+)?(?:differently|again))\b|讲简单|换个说法|类比|重讲|一句话|再说",
    "governing_design_source": r"\b(?:figma|design\.md|annotated\s+\w*\s*mock|mock-?ups?|design\s+(?:source|system|spec)|governing\s+reference)\b|设计稿|设计源|截图还原|风格",
    "design_compare_align": r"\b(?:compare|align|match|follow|conform)\b|对齐|对照|还原|按设计|评审|信息架构",
    "design_source_precedence": r"\b(?:win|wins|governs?|takes\s+precedence|any\s+conflict)\b|为准|优先",
    "local_worktree_state": r"\b(?:work(?:ing)?\s?tree|dirty|uncommitted|in-progress\s+edits|existing\s+edits|git\s+(?:status|diff)|local\s+files|release\s+branch)\b|工作区|未提交|之前的改动|main\s*分支|git\s*diff",
    "workspace_mutation_intent": r"\b(?:commit|stage|stash|reset|revert|push|edit(?:ing)?|keep\s+fixing|touching)\b|提交|暂存|修改|编辑|继续改|推送",
    "task_change_isolation": r"\b(?:isolate|task-scoped|this\s+task'?s|only\s+task|separate\s+my|scoped)\b|只.{0,4}(?:改|提交|修改)?本任务|别覆盖|保留它们",
    "dispatch_runtime_entity": r"\bai[- ]dispatch\b",
    "dispatch_development_action": r"\b(?:implement|fix|change|refactor|extend|add|migrate|repair|debug|integrat\w+|upgrade|support|wir\w+|apply)\w*\b|修|改|实现|新增|增加|加一个|支持|重构|升级|调试|应用",
    "dispatch_owned_runtime_subsystem": r"\b(?:provider\s+(?:adapter|registry|integration)|model\s+(?:registry|resolver|alias\w*)|route\s+(?:resolver|table)|routing|fallback\s+(?:chain|routing)|resume\s+runtime|stream(?:ing)?\s+runtime)\b|注册表|适配器|模型别名|路由表|解析器",
}


def _s(name: str, weight: int, pattern: str = "", *targets: str, routing: bool = True, all_of: tuple = (), **more) -> Signal:
    made = tuple(c if isinstance(c, Composition) else Composition(c) for c in all_of)
    return Signal(name, weight, (pattern,) if pattern else (), targets, made, routing and weight > 0, **more)


#: Ids, weights, targets and compositions are fixed values.
REGISTRY = (
    _s("ui_surface", 8, r"\b(?:ui|frontend|front-end|browser|web page)\b|页面|界面|浏览器"),
    _s("ui_implementation", 12, r"\b(?:implement|build|fix|add)\b.{0,40}\b(?:ui|frontend|component|page)\b|(?:实现|开发|修).{0,20}(?:页面|界面|组件)"),
    _s("ui_design_only", -32, r"\bdesign (?:only|judg\w+ only)\b|只(?:做|谈)设计", "ui_implementation", "information_design", "ui_delivery_work"),
    _s("ui_cosmetic_only", -24, r"\b(?:only|just) (?:change )?(?:the )?(?:colou?rs?|spacing|font|style)\b|只改(?:颜色|样式)"),
    _s("ui_delivery_work", 13, r"\b(?:deliver|ship)\w*\b.{0,40}\b(?:ui|page|frontend)\b.{0,60}\breal\b|(?:交付).{0,20}(?:页面|界面)", all_of=(("ui_product_surface", "real_service_data", "real_user_path_validation"),)),
    _s("ui_surface_noise", -30, r"\b(?:ui|browser)\b.{0,30}\b(?:is|as) (?:just )?(?:noise|background)\b", "ui_surface"),
    _s("ui_example_discussion", -30, r"\b(?:example|docs?|documentation)\b.{0,40}\b(?:ui|browser)\b", "ui_surface"),
    _s("goal_execute", 18, r"(?:^|\s)/goal\b|\bexecute (?:the|this) goal\b|执行(?:这个)?目标", all_of=(("agent_goal_container", "direct_execution", "closure_evidence"),)),
    _s("goal_example_discussion", -34, r"\b(?:example|docs?|documentation)\b.{0,40}(?:/goal|\bgoal)\b", "goal_execute"),
    _s("explicit_execute", 8, r"\b(?:just do it|execute|implement|build|fix|repair|carry (?:it )?out|start working)\b|直接(?:做|执行)|落地|开干|修复|实现", routing=False),
    _s("real_validation", 6, r"\b(?:real|actual|end[- ]to[- ]end) (?:path|validation|test)\b|真实(?:路径|验证)", routing=False),
    _s("review_surface", 10, r"\b(?:approve|review) (?:the )?(?:draft|card)s?\b|审核(?:草稿|卡片)"),
    _s("provider_adapter_boundary", 12, r"\bprovider adapter\b|\bshared hook runtime\b|适配器边界"),
    _s(
        "dispatch_runtime_development",
        14,
        instead=True,
        all_of=(Composition(("dispatch_runtime_entity", "dispatch_development_action", "dispatch_owned_runtime_subsystem"), 2, 280),),
        kept_if=(r"(?:修)?改的是\s*ai[- ]dispatch.{0,32}不是(?:调用|使用)",),
        terms=("ai-dispatch", "runtime", "provider"),
    ),
    _s("package_install_validation", 12, r"\b(?:tarball|clean install|npm pack|install test)\b|安装验证"),
    _s(
        "delivery_gate",
        12,
        r"\b(?:delivery gate|ready to (?:ship|merge|submit)|final review|acceptance gate)\b|交付门|验收门",
        all_of=(("readiness_decision", "delivery_layers", "fresh_delivery_evidence"), ("readiness_decision", "delivery_layers"), ("readiness_decision", "fresh_delivery_evidence")),
    ),
    _s(
        "single_truth_version",
        12,
        r"\bsingle (?:source of )?truth\b|唯一(?:口径|版本|真源)",
        all_of=(("legacy_fact_path", "retire_or_converge", "single_authority"), Composition(("legacy_fact_path", "retire_or_converge", "migration_complete", "no_dependent_consumer"), 2)),
    ),
    _s("source_truth_chain", 12, r"\bsource of truth chain\b|\brequirements? (?:to|and) (?:design|acceptance)\b|溯源", all_of=(("source_reconciliation", "requirement_design_source", "runtime_implementation_evidence"),)),
    _s("failure_triage", 12, r"\b(?:environment|infra\w*)\b.{0,60}\b(?:or|vs|from)\b.{0,30}\b(?:business|product|code) (?:bug|failure|error)\b|环境问题还是", all_of=(("failure_observation", "tool_environment_boundary", "triage_across_layers"),)),
    _s("temporary_mock_boundary", 12, instead=True, keeps_compositions=True, all_of=(("substitute_implementation", "prototype_exit_boundary", "real_proof_boundary"), ("substitute_implementation", "real_proof_boundary"))),
    _s("external_model_review", 12, r"\b(?:multi[- ]model|external model) (?:review|audit)\b|多模型(?:审查|评审)", all_of=(Composition(("multiple_model_reviewers", "independent_model_review", "review_source_bundle", "primary_adjudication"), 2),)),
    _s("model_comparison_only", -34, r"\bcompare\b.{0,30}\b(?:models?|prices?|pricing)\b|\bwhich model is better\b|模型对比", "external_model_review"),
    _s("rule_governance", 12, r"\brule (?:layer|governance)\b|规则(?:治理|层)", all_of=(("agent_entry_rule_entity", "rule_governance_intent", "rule_layer_problem"),)),
    _s(
        "long_running_liveness",
        12,
        r"\b(?:heartbeat|inactivity|stall(?:ed)?|liveness)\b|心跳|卡住",
        kept_if=(r"\b(?:agent|worker|provider|bridge)\b.{0,100}\b(?:heartbeat|progress|stream)\b.{0,100}(?:\bkill|timeout|wall[- ]clock|超时|误杀)", r"\bheartbeat\b.{0,100}(?:\bno\b|without|没有).{0,30}(?:progress|进展)"),
    ),
    _s(
        "control_plane_worker_divergence",
        13,
        r"\b(?:lease|queue|capacity|control plane)\b.{0,80}\b(?:diverge\w*|mismatch|but no worker|stale)\b|控制面",
        kept_if=(r"(?:capacity|worker pool|容量).{0,60}(?:not full|has room|还有容量|容量未满).{0,80}(?:queued|pending|排队)",),
        terms=("control plane", "worker", "lease", "queue"),
    ),
    _s("control_plane_divergence_ruled_out", -36, r"\bno (?:mismatch|divergence)\b|已排除.{0,12}不一致", "control_plane_worker_divergence"),
    _s("runtime_reference_context", -34, r"\b(?:fixture|simulation|hypothetical|sample|documentation|example|quotes?|copy|readme)\b.{0,60}\b(?:runtime|worker|lease|dispatch)\b", "dispatch_runtime_development", "control_plane_worker_divergence"),
    _s("dispatch_tool_use_context", -38, r"\b(?:use|using|call|via|ask|asks|let|have|run|with) ai[- ]dispatch\b|用\s*ai[- ]dispatch|让\s*ai[- ]dispatch\s*(?:派|评审)|\bai[- ]dispatch send\b", "dispatch_runtime_development"),
    _s("resource_lifecycle_cleanup", 12, r"\b(?:clean ?up|release|reclaim|discard)\b.{0,40}\b(?:resources?|process(?:es)?|workers?|leases?)\b|资源(?:清理|回收)"),
    _s("bridge_runtime_validation", 12, r"\b(?:bridge|bot|watchdog)\b.{0,40}\b(?:status|validate|check|running)\b"),
    _s("bridge_runtime_absent", -36, r"\bno (?:bridge|bot)\b|\bwithout (?:a )?bridge\b", "bridge_runtime_validation"),
    _s(
        "design_source_alignment",
        12,
        instead=True,
        all_of=(("governing_design_source", "design_compare_align", "design_source_precedence"), ("governing_design_source", "design_compare_align"), ("ui_product_surface", "design_compare_align")),
    ),
    _s(
        "information_design",
        12,
        r"\b(?:information design|visual hierarchy|mental load|cognitive load)\b|信息设计|心智负担",
        all_of=(("user_output_surface", "decision_first", "defer_diagnostics"), Composition(("user_output_surface", "decision_first", "hierarchy_overload"), 2)),
    ),
    _s("comprehension_failure", 12, r"没看懂", all_of=(("stated_non_understanding", "explanation_repair_request"),)),
    _s("overengineering_review", 12, r"\b(?:over[- ]?engineered|needless complexity|too complex)\b|过度设计", all_of=(Composition(("specific_change_review", "structural_complexity", "present_justification"), 2),)),
    _s(
        "architecture_quality",
        13,
        r"\b(?:root[- ]cause|clean architecture|cohesi\w+|clean logic)\b|根因|架构质量",
        all_of=(("trace_execution_path", "consumer_deployment_facts", "final_boundary_choice"), ("trace_execution_path", "final_boundary_choice")),
        terms=("architecture", "root cause", "module boundary"),
    ),
    _s("retrieval_engine_architecture", 13, r"\b(?:retrieval engine|recall engine|scoring (?:logic|architecture)|signal routing)\b|召回引擎", all_of=(("retrieval_symptom", "retrieval_pipeline_stage", "retrieval_stage_diagnosis"),)),
    _s("high_risk_action", 14, instead=True, keeps_compositions=True, all_of=(("irreversible_operation", "authorization_stop_boundary"),)),
    _s("high_risk_authorized", -38, "", "high_risk_action", all_of=(("irreversible_operation", "user_imperative_authorization"),)),
    _s("git_operation", 14, r"\bgit (?:add|commit|push|diff|stash|rebase|merge|reset)\b|提交代码", routing=False),
    _s("git_source_noise", -34, r"\b(?:from|on|via) github\b|\bgithub (?:issue|link|page)\b", "git_operation", "worktree_diff_operation"),
    _s("worktree_read_only", -36, r"\b(?:read[- ]only|just look|only inspect)\b.{0,40}\b(?:diff|worktree|branch)\b|只看.{0,12}(?:diff|差异)", "worktree_diff_operation"),
    _s("worktree_diff_operation", 14, instead=True, all_of=(("local_worktree_state", "workspace_mutation_intent"), ("local_worktree_state", "workspace_mutation_intent", "task_change_isolation"))),
    _s("historical_session_lookup", 12, r"\b(?:previous|earlier|historical|past) sessions?\b|历史会话"),
    _s("business_goal_discussion", -36, r"\b(?:okr|business|quarterly|sales|growth) (?:growth )?goals?\b|业务目标", "goal_execute"),
    _s("explain_only", -24, r"\b(?:just|only) (?:explain|discuss|describe)\b|\bexplain only\b|只(?:解释|讨论)", "explicit_execute", "goal_execute", "dispatch_runtime_development", "control_plane_worker_divergence"),
)

# The modes of intent, in order.
INTENT_MODES = ("execute", "discuss", "review", "debug", "plan", "explain", "operate")
# What a segment of each mode says.
INTENTS = {
    "execute": (
        r"\/goal\b",
        r"\b(?:implement|build|create|fix|repair|update|change|add|remove|refactor|run|execute|deploy|install|write|handle|investigate|resolve|diagnose|modify|edit)\b",
        r"创建.{0,6}目标|开干|开始处理|做完|实现|落地|修复|执行|开发|新增|修改|重构|处理|追查|调查|解决|排查",
    ),
    "explain": (r"我想知道|为什么|原理|解释一下|说明一下|怎么理解|what is|what\b.*\bmeans?\b|why\b|explain",),
    "discuss": (r"\bdiscuss\b|怎么看|评判一下|好处坏处|是否可以|要不要|我想了解|讨论|方案|策略|判断一下",),
    "review": (r"\breview\b|审查|评审|帮我看|风险|复盘",),
    "debug": (r"报错|失败|排查|追查|调查|根因|debug|修复|为什么不对|不生效|异常|\b(?:troubleshoot|diagnose|investigate|failure|failed|error|exception)\b",),
    "operate": (r"git push|开\s*PR|发布|部署|删除数据|生产配置|重启生产|授权|付费|额度",),
    "plan": (r"计划|roadmap|里程碑|拆解|排期|优化计划|实施方案",),
}
EXECUTION = ("explicit_execute", "goal_execute")

def _whole(pattern: str) -> str:
    return "(?s)" + T.ascii_bounds(pattern)


def _any_of(*patterns: str) -> str:
    """One pattern for fixed ones, whatever the case of their letters."""
    return "(?i)" + T.ascii_bounds("|".join(f"(?:{p})" for p in patterns))


def _together(c: Composition) -> str:
    """One of the atoms begins, and all others begin behind it, within the span and with at most ``gap`` ends of sentences between."""
    own = {a: f"(?:{T.ascii_bounds(ATOMS[a])})" for a in c.atoms}
    sentence = f"(?:[^{SENTENCE_END}]*[{SENTENCE_END}]+){{0,{c.gap}}}[^{SENTENCE_END}]*?"
    near = {a: f"(?=.{{0,{c.span}}}?{p})(?={sentence}{p})" for a, p in own.items()}
    return "(?s)" + "|".join(f"(?={own[a]})" + "".join(near[b] for b in c.atoms if b != a) for a in c.atoms)


def _composed(low: Column, c: Composition) -> Column:
    """Whether a text shows a composition.  Each of its atoms must stand somewhere, which is sought first: that reads a text once,
    while their nearness is tried at every place."""
    hit = low.rlike("(?s)" + T.ascii_bounds(ATOMS[c.atoms[0]]))
    for a in c.atoms[1:]:
        hit = hit & low.rlike("(?s)" + T.ascii_bounds(ATOMS[a]))
    return hit & low.rlike(_together(c))


def _found(low: Column, s: Signal) -> Column:
    hit = F.lit(False)
    if s.patterns and not s.instead:
        hit = low.rlike(_whole("|".join(s.patterns)))
    for c in s.compositions:
        hit = hit | _composed(low, c)
    return hit


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once for a row."""
    return F.get(F.transform(F.array(value), use), 0)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _parts(low: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(low, pattern), lambda p: F.trim(p)), lambda p: p != "")


def segments(text: Column) -> Column:
    """A prompt's segments: sentences, cut where a word turns to another step or thought."""
    return _parts(text, _any_of(SEGMENT_BREAK))


def context_segments(text: Column) -> Column:
    """A prompt's sentences, and its blocks that state how things are now."""
    return F.array_distinct(F.concat(_parts(text, CONTEXT_BREAK), F.transform(F.regexp_extract_all(text, F.lit(_any_of(CURRENT_BLOCK)), 0), lambda b: F.trim(b))))


#: Signals that single spacing may hide where lines have meaning (fields of a task), and a mere reference to one.
LINED_SIGNALS = ("control_plane_worker_divergence", "dispatch_runtime_development")
REFERENCE = "runtime_reference_context"


def _views(text: Column) -> Column:
    """A prompt's narrative, what is not negated in it (where that differs), and the raw text (where lines have meaning)."""
    narrative, positive, raw = F.lower(T.strip_noise(text)), F.lower(T.strip_noise(P.strip_negated(text))), F.lower(text)
    lined = raw.rlike(_any_of(LINED)) | raw.rlike(_any_of(CURRENT_BLOCK))
    view = lambda name, said: F.struct(F.lit(name).alias("view"), said.alias("said"))
    return F.array_compact(F.array(view("narrative", narrative), F.when(positive != narrative, view("positive", positive)), F.when(lined, view("raw", raw))))


def _parts_of(said: Column) -> Column:
    part = lambda name: lambda p: F.struct(F.lit(name).alias("part"), p.alias("said"))
    return F.concat(F.array(part("whole")(said)), F.transform(segments(said), part("segment")), F.transform(context_segments(said), part("context")))


def _hits(said: Column, registry: tuple[Signal, ...], among: Column | None = None) -> Column:
    """Ids of the signals that a text shows, sought only among the given ones."""
    sought = lambda s: F.lit(True) if among is None else F.array_contains(among, s.id)
    return F.array_compact(F.array(*[F.when(sought(s) & _found(said, s), F.lit(s.id)) for s in registry]))


def _shown(views: DataFrame, keys: list[str], registry: tuple[Signal, ...]) -> DataFrame:
    """What each part of the views shows: signal ids (of those that the whole shows), those that a form keeps, whether it denies
    them, and intents.  Most prompts show few signals, so their parts are asked for few."""
    wholes = views.withColumn("seen", _hits(F.col("said"), registry))
    rows = wholes.select(*keys, "view", "seen", F.inline(_parts_of(F.col("said"))))
    said = F.col("said")
    hits = F.when(F.col("part") == "whole", F.col("seen")).otherwise(_hits(said, registry, F.col("seen")))
    keeps = []
    for s in registry:
        forms = [said.rlike(_whole(p)) for p in s.kept_if] + [_composed(said, c) for c in s.compositions if s.keeps_compositions]
        for form in forms:
            keeps.append(F.when((F.col("view") == "narrative") & (F.col("part") == "whole") & form, F.lit(s.id)))
    kept = F.array_compact(F.array(*keeps)) if keeps else _strings(())
    spared = F.array_compact(F.array(*[F.when(said.rlike(_any_of(p)), F.lit(i)) for i, p in NO_DENIAL.items()]))
    rows = rows.withColumns({"hits": hits, "kept": kept, "denied": said.rlike(_any_of(*DENIED)), "spared": spared}).drop("seen")
    aimed = [s.id for s in registry if set(s.targets) & set(EXECUTION)]
    earnest = F.arrays_overlap("hits", _strings(EXECUTION)) & ~F.arrays_overlap("hits", _strings(aimed)) & ~said.rlike(_any_of(NO_EXECUTION))
    modes = [F.when(said.rlike(_any_of(*INTENTS[m])) & (earnest if m == "execute" else F.lit(True)), F.lit(m)) for m in INTENT_MODES]
    rows = rows.withColumn("modes", F.when(F.col("part") == "segment", F.array_compact(F.array(*modes))).otherwise(_strings(())))
    return rows.where((F.col("part") == "whole") | (F.size("hits") > 0) | (F.size("modes") > 0)).drop("said")


def _judged(parts: Column, registry: tuple[Signal, ...]) -> Column:
    """Ids of the signals that the parts of one text leave, in the registry's order.

    A positive signal is out where every segment that shows it denies it.  A negative signal takes out what it aims at,
    unless a segment shows a target without it; then the negative signal itself is out.
    """
    aims = {s.id: s.targets for s in registry if s.targets}
    of = lambda name: F.filter(parts, lambda p: p["part"] == name)

    def kept(x: Column) -> Column:
        seen, holds = x["seen"], lambda p, i: F.array_contains(p["hits"], i)
        positive = _strings([s.id for s in registry if s.positive])
        denied = F.filter(F.array_intersect(seen, positive), lambda i: F.exists(x["segments"], lambda p: holds(p, i)) & ~F.exists(x["segments"], lambda p: holds(p, i) & (~p["denied"] | F.array_contains(p["spared"], i))))
        left = F.array_except(seen, denied)
        if not aims:
            return left
        targets = F.create_map(*[y for k, v in aims.items() for y in (F.lit(k), _strings(v))])
        alone = lambda i: lambda p: F.arrays_overlap(p["hits"], F.element_at(targets, i)) & ~holds(p, i)
        independent = lambda i: F.exists(x["contexts"], alone(i)) | ((i != REFERENCE) & F.exists(x["segments"], alone(i)))
        aiming = F.array_intersect(seen, _strings(tuple(aims)))
        contextual = F.filter(aiming, independent)
        hit = F.flatten(F.transform(F.array_except(aiming, contextual), lambda i: F.element_at(targets, i)))
        return F.filter(left, lambda i: ~F.array_contains(hit, i) & ~F.array_contains(contextual, i))

    whole = F.coalesce(F.get(of("whole"), 0)["hits"], _strings(()))
    return _once(F.struct(whole.alias("seen"), of("segment").alias("segments"), of("context").alias("contexts")), kept)


def prompt_signals(prompts: DataFrame, *keys: str, text: str = "text", registry: tuple[Signal, ...] = REGISTRY) -> DataFrame:
    """``keys`` (which tell rows apart), ``signals`` (an array of ``id``, ``polarity`` and ``weight`` in the registry's order) and
    ``intent_modes`` of each prompt.

    A positive signal must also show in what is not negated, or in one of the forms that keep it.  Where lines have
    meaning, the raw text brings back those of LINED_SIGNALS, and the first of them outweighs a mere reference.
    ``execute`` counts where a segment asks for it in earnest, and removes ``explain`` and ``discuss``.
    """
    rows = prompts.select(*keys, F.inline(_views(F.coalesce(text, F.lit("")))))
    gathered = _shown(rows, list(keys), registry).groupBy(*keys).agg(F.collect_list(F.struct("view", "part", "hits", "kept", "denied", "spared", "modes")).alias("parts"))
    view = lambda name: F.filter("parts", lambda p: p["view"] == name)
    same = F.size(view("positive")) == 0
    left = F.transform(_strings(("narrative", "positive", "raw")), lambda v: _judged(F.filter("parts", lambda p: p["view"] == v), registry))
    gathered = gathered.withColumn("left", left)
    gathered = gathered.withColumns({"found": F.get("left", 0), "affirmed": F.get("left", 1), "lined": F.get("left", 2)})
    kept = F.flatten(F.transform("parts", lambda p: p["kept"]))
    negative = _strings([s.id for s in registry if not s.positive])
    back = F.array_except(F.array_intersect("lined", _strings(LINED_SIGNALS)), "found")
    stays = lambda i: F.array_contains(negative, i) | same | F.array_contains(F.concat("affirmed", kept), i)
    outweighed = lambda i: (i == REFERENCE) & F.array_contains(back, F.lit(LINED_SIGNALS[0]))
    ids_ = F.concat(F.filter("found", lambda i: stays(i) & ~outweighed(i)), back)
    table = F.create_map(*[x for s in registry for x in (F.lit(s.id), F.struct(F.lit("positive" if s.positive else "negative").alias("polarity"), F.lit(s.weight).alias("weight")))])
    named = F.transform(ids_, lambda i: F.struct(i.alias("id"), F.element_at(table, i)["polarity"].alias("polarity"), F.element_at(table, i)["weight"].alias("weight")))
    said = F.flatten(F.transform(F.when(same, view("narrative")).otherwise(view("positive")), lambda p: p["modes"]))
    modes = F.array_intersect(_strings(INTENT_MODES), said)
    calm = F.when(F.array_contains(modes, "execute"), F.array_except(modes, _strings(("explain", "discuss")))).otherwise(modes)
    return gathered.select(*keys, named.alias("signals"), calm.alias("intent_modes"))


def positives(signals: Column) -> Column:
    """Map of positive signal id to weight."""
    return F.map_from_entries(F.transform(F.filter(signals, lambda s: s["polarity"] == "positive"), lambda s: F.struct(s["id"], s["weight"])))


def ids(signals: Column, polarity: str | None = None) -> Column:
    kept = F.filter(signals, lambda s: s["polarity"] == polarity) if polarity else signals
    return F.transform(kept, lambda s: s["id"])


def signal_terms(signals: Column, registry: tuple[Signal, ...] = REGISTRY) -> Column:
    """Query terms of a prompt's positive signals: those that the registry gives, else the words of the id."""
    table = F.create_map(*[x for s in registry for x in (F.lit(s.id), _strings(s.terms or tuple(s.id.split("_"))))])
    return F.array_distinct(F.flatten(F.transform(ids(signals, "positive"), lambda i: F.element_at(table, i))))


def negative_targets(signals: Column, registry: tuple[Signal, ...] = REGISTRY) -> Column:
    """What the negative signals of a prompt aim at."""
    none = F.array().cast("array<string>")
    parts = [F.when(F.array_contains(ids(signals), s.id), F.array(*map(F.lit, s.targets))).otherwise(none) for s in registry if s.targets]
    return F.array_distinct(F.concat(none, *parts))


def targets_of(signal: Column, registry: tuple[Signal, ...] = REGISTRY) -> Column:
    """What one signal aims at."""
    table = F.create_map(*[x for s in registry if s.targets for x in (F.lit(s.id), _strings(s.targets))])
    return F.coalesce(F.try_element_at(table, signal), _strings(()))


def unknown_ids(wanted: Column, registry: tuple[Signal, ...] = REGISTRY) -> Column:
    """Signal ids that the registry doesn't know."""
    return F.array_except(wanted, F.array(*[F.lit(s.id) for s in registry]))

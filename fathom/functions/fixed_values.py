"""Word lists that decide which rows a query returns, and so must stay as they are."""

# Stop words of classic ranking.
CLASSIC_STOP_WORDS = (
    "的 是 在 了 和 与 或 也 都 就 不 有 这 那 我 你 他 她 它 个 上 下 中 来 去 说 对 要 "
    "the a an is are was were be been to of in for on with at by from and or but not this that it as"
).split()

# Stop words of the full-text index.
FTS_STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "could should may might must shall can need it its this that these those i you he she we they what which who when where why "
    "how all each every both few more most other some such no not only same so than too very just as if then because while although"
).split()

# Stop words of query expansion and keywords.
QUERY_STOP_WORDS = (
    "的 是 在 了 和 与 或 但 这 那 地 得 我 你 他 她 它 们 啊 吧 呢 吗 呀 一个 一些 什么 怎么 如何 为什么 因为 所以 如果 就 才 都 也 还 又 很 太 真 好 对 错"
).split()

# Synonyms, most relevant first.
SYNONYMS = {
    "编程": ["程序设计", "写代码", "coding"],
    "代码": ["程序", "code", "源码"],
    "函数": ["方法", "function", "method"],
    "变量": ["variable", "参量"],
    "数组": ["列表", "array", "list"],
    "对象": ["object", "实例"],
    "类": ["class", "类型"],
    "配置": ["设置", "settings", "config", "setup"],
    "安装": ["部署", "install", "setup", "搭建"],
    "运行": ["执行", "启动", "run", "execute"],
    "停止": ["关闭", "停止运行", "stop"],
    "数据": ["data", "信息"],
    "数据库": ["db", "database", "资料库"],
    "存储": ["保存", "storage", "save"],
    "读取": ["加载", "读入", "load", "read"],
    "文件": ["档案", "file", "文档"],
    "文件夹": ["目录", "folder", "directory"],
    "路径": ["path", "directory"],
    "搜索": ["查询", "检索", "search", "find"],
    "查询": ["搜索", "查找", "query", "search"],
    "索引": ["index", "建立索引"],
    "服务器": ["server", "服务端", "后端"],
    "客户端": ["client", "前端"],
    "向量": ["embedding", "矢量", "vector"],
    "模型": ["model", "算法"],
    "训练": ["train", "学习"],
    "推理": ["inference", "预测", "predict"],
    "语义": ["semantic", "含义", "意义"],
    "文档": ["docs", "说明书"],
    "教程": ["指南", "tutorial", "guide"],
    "示例": ["例子", "sample", "example", "demo"],
    "说明": ["解释", "文档", "documentation"],
    "开发": ["development", "研发"],
    "测试": ["testing", "test"],
    "调试": ["debug", "调试程序"],
    "优化": ["optimize", "调优"],
    "系统": ["system", "体系"],
    "错误": ["报错", "error", "bug", "异常"],
    "项目": ["project", "工程", "方案"],
    "功能": ["特性", "feature", "能力"],
    "模块": ["module", "组件", "component"],
    "接口": ["api", "interface", "端口"],
    "平台": ["platform"],
    "环境": ["environment", "env"],
    "版本": ["version", "版本号"],
    "学习": ["study", "掌握"],
    "理解": ["明白", "懂"],
    "知道": ["了解", "认识"],
    "使用": ["应用", "运用"],
    "实现": ["完成", "达成"],
    "创建": ["新建", "建立"],
    "删除": ["移除", "remove"],
    "修改": ["更新", "更改", "编辑"],
    "查看": ["浏览", "看"],
    "获取": ["取得", "得到"],
}

# Folder names that are no keywords.
FOLDER_STOP_WORDS = "notes docs files attachments draft archive".split()

# fixed values: what is said about an answer, word for word
SUGGESTIONS = {
    "more": "还有更多相关结果，可以尝试更精确的查询或使用 Deep 模式获取更多内容。",
    "none": "未找到相关内容，请尝试不同的关键词或检查索引是否完整。",
    "few": "结果较少，可以尝试扩展查询词或使用 Deep 模式。",
}

# fixed values: what stands around the context and the question of a prompt, word for word; for plain and for hierarchical search
PROMPT = "基于以下知识库内容回答问题：\n\n{context}\n\n问题：{query}\n\n请根据上述内容提供准确、详细的回答，并在回答中引用来源。"
HIERARCHICAL_PROMPT = "基于以下上下文回答问题：\n\n{context}\n\n问题：{query}\n\n请基于上下文内容回答，如果上下文中没有相关信息，请明确说明。"

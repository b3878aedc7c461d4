"""Keyword lists as data, and expressions that count or tag with them. Matching is plain substring on lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists that decide scores and labels.
DIRECTION = ["dem", "digital elevation", "terrain", "gis", "spatial analysis", "erosion", "gully", "loess", "dry-hot", "watershed", "soil", "remote sensing", "sentinel", "landsat", "insar", "uav", "sfm"]
METHOD_RIGOR = ["benchmark", "compar", "baseline", "ablation", "cross-valid", "reproducib", "open source", "github", "code availab"]
NOVELTY = ["novel", "first", "new approach", "we propose", "innovative", "we introduce", "new method"]
EVIDENCE = ["dataset", "open data", "publicly availab", "sentinel", "landsat", "modis", "ground truth", "field data", "citizen scien", "statistically significant", "p-value", "confidence interval"]
ARGUMENT = ["systematic", "comprehensive", "framework"]
TRANSFER = ["open source", "python", "code availab", "github", "reproducib", "tutorial", "benchmark", "tool", "pipeline", "framework", "workflow", "dem", "digital elevation", "terrain", "gis", "spatial analysis", "erosion", "gully", "loess", "dry-hot", "watershed"]
FALSE_POSITIVE = ["computed tomography", "ct scan", "ct image", "ct scanner", "ct colonography", "x-ray", "radiolog", "clinical trial", "patient diagnosis", "tumor", "cancer", "malignan", "metastas", "drug", "pharmac", "surgery", "surgical", "biomedical", "genomic", "drosophila", "zebrafish", "cell line", "in vitro", "in vivo", "book review", "editorial", "commentary", "corrigendum", "erratum", "ct enterography", "ct urography", "ct angiography", "mammography", "dementia", "alzheimer", "parkinson", "multiple sclerosis", "electrocardiogram", "electroencephalogram"]
CT_ADJACENT = ["ct-", "ct ", "computed tomography", "scan", "scanner"]
CT_CONTEXT = ["terrain", "elevation", "gis", "remote sens", "geospat", "slope", "topograph", "landslide", "erosion"]
REVIEW_ONLY = ["book review", "literature review", "a review of", "a systematic review", "review article"]
REVIEW_CONTEXT = ["gis", "geospat", "remote sens", "spatial", "terrain", "elevation", "dem", "satellite"]
HARD_CORE = ["dem", "digital elevation", "digital terrain", "topograph", "geomorpholog", "geomorphometry", "terrain analysis", "terrain factor", "terrain attributes", "landform", "gully", "gully erosion", "gully morphology", "soil erosion", "erosion model", "rusle", "soil loss", "rill erosion", "bank erosion", "loess plateau", "黄土高原", "dry-hot valley", "干热河谷", "jinsha", "yuanmou", "元谋", "soil conservation", "soil water conservation", "water and soil conservation", "desertification", "slope gradient", "slope aspect", "curvature", "topographic wetness", "ls factor", "stream power", "drainage network"]
EXTENDED = ["gis", "geographic information", "spatial analysis", "spatial model", "spatial statistic", "geospatial", "spatial pattern", "spatial distribution", "watershed", "catchment", "sediment yield", "erosion risk", "erosion assessment", "erosion control", "srtm", "aster gdem", "lidar dem", "uav dem", "land degradation"]
LOW_PRIORITY = ["remote sensing classification", "land cover classification", "land use classification", "image segmentation", "semantic segmentation", "large language model", "foundation model", "chatgpt", "gpt-", "prompt engineering", "urban heat island", "urban expansion", "urban sprawl", "urban growth", "urbanization pattern", "traffic", "transportation", "road network", "nighttime light", "population density", "climate change", "carbon sequestration", "biodiversity", "ecosystem service", "a comprehensive review", "a systematic review"]
REINFORCEMENT = ["dem", "digital elevation", "terrain", "erosion", "gully", "geomorpholog", "soil", "loess", "dry-hot", "watershed", "slope", "topograph"]
DEM_BONUS = ["dem", "digital elevation", "digital terrain", "topograph", "geomorpholog", "geomorphometry", "terrain analysis", "terrain factor", "terrain attributes", "landform"]
GULLY_BONUS = ["gully", "gully erosion", "gully morphology", "soil erosion", "erosion model", "rusle", "rill erosion", "bank erosion"]
REGION_BONUS = ["loess plateau", "黄土高原", "dry-hot valley", "干热河谷", "jinsha", "金沙江", "yuanmou", "元谋"]
GIS_BONUS = ["spatial analysis", "spatial model", "spatial statistic", "gis", "geospatial", "spatial distribution"]
METHOD_WORDS = ["machine learning", "deep learning", "neural network", "random forest", "xgboost", "cnn", "segmentation", "classification", "object detection", "causal", "time series", "regression", "ensemble", "transfer learning", "explainable", "attention mechanism"]
TOOL_WORDS = ["python", "r package", "open source", "github", "code available", "benchmark", "dataset", "workflow", "pipeline", "automation", "reproducib"]
CROSS_WORDS = ["indicator", "evaluation framework", "multi-criteria", "decision making", "uncertainty", "sensitivity analysis", "comparative study", "quantitative method"]
S2_TITLE_GIS = ["remote sens", "gis", "geospat", "spatial", "land", "terrain", "earth observ"]
S2_VENUE_GIS = ["remote sens", "gis", "geosci", "earth", "environ"]
S2_TITLE_AI = ["machine learn", "deep learn", "neural", "ai ", "agent"]
S2_TITLE_STAT = ["causal", "statistic", "econometric", "regression"]
ECOLOGY = ["ecolog", "ecosystem", "soil", "water", "climat", "carbon", "environment", "hydrolog", "vegetation", "land degradation", "erosion", "biodiversity", "conservation"]
CATEGORIES = {"gis": "遥感/GIS", "ai": "AI/计算机", "stat": "统计/方法", "eco": "生态环境", "cross": "交叉学科"}
FIXED_TAGS = {
    "DEM": ["dem", "digital elevation", "digital terrain", "srtm", "aster gdem", "lidar dem"],
    "数字地形分析": ["digital terrain analysis", "terrain analysis", "数字地形分析"],
    "地形因子": ["terrain factor", "terrain attributes", "地形因子", "slope gradient", "curvature", "topographic wetness", "ls factor"],
    "沟谷地貌": ["gully", "gully morphology", "gully development", "gully erosion", "沟谷", "谷", "channel"],
    "冲沟": ["gully", "冲沟", "沟蚀", "rill erosion", "bank erosion"],
    "土壤侵蚀": ["soil erosion", "erosion model", "rusle", "soil loss", "sediment", "土壤侵蚀", "侵蚀"],
    "GIS空间分析": ["gis", "spatial analysis", "spatial model", "geospatial", "地理信息"],
    "空间建模": ["spatial model", "spatial statistic", "spatial pattern", "空间建模", "空间分析"],
    "黄土高原": ["loess plateau", "黄土高原"],
    "干热河谷": ["dry-hot valley", "干热河谷", "jinsha", "yuanmou", "金沙江", "元谋"],
    "水土保持": ["soil conservation", "soil water conservation", "水土保持", "water and soil"],
    "荒漠化防治": ["desertification", "land degradation", "荒漠化", "荒漠"],
    "地貌形态": ["geomorpholog", "geomorphometry", "landform", "地貌", "地形"],
}
CN_SECTION_WORDS = ["摘要", "方法", "结果", "讨论", "结论", "引言", "研究", "数据", "分析", "实验", "模型", "参考文献"]


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur in `text` (each counts once)."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def any_hit(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def tags(text: Column, lexicon: dict[str, list[str]], most: int) -> Column:
    """Labels with any of their words in `text`, in the lexicon's order, at most `most`."""
    marked = F.array(*(F.when(any_hit(text, words), F.lit(label)) for label, words in lexicon.items()))
    return F.slice(F.filter(marked, lambda x: x.isNotNull()), 1, most)


# the same as SQL text, for checking against another engine


def sql_hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"(case when contains({text}, '{w}') then 1 else 0 end)" for w in words) + ")"


def sql_any(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"

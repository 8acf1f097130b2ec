"""Words of the board that speak for a rise or a fall, for functions.text.lexicon_scorer."""

from __future__ import annotations

# Terms, single characters that are a whole comment, and characters that turn a term's sign.
RISE = """
噴 噴出 大噴 狂噴 起飛 飛天 漲停 鎖漲停 漲爆 大漲 狂漲 創新高 新高 突破 長紅 紅k
看多 做多 偏多 多軍 多頭 看好 利多 看漲 會漲 必漲 起漲 補漲 反彈 跌深反彈 軋空
加碼 進場 上車 抄底 撿便宜 低接 買進 買入 買爆 買起來 歐印 all in 梭哈 續抱 抱緊
發大財 賺爆 穩了 護盤 上看
""".split()
FALL = """
崩 崩盤 大跌 重挫 暴跌 跌停 鎖跌停 下殺 殺盤 破底 跌破 新低 長黑 黑k
看空 做空 偏空 空軍 空頭 看壞 利空 利多出盡 看跌 會跌 跌爆 泡沫 見頂 頭部
出貨 倒貨 逃命 快逃 快跑 出清 停損 認賠 套牢 被套 住套房 套房 韭菜 割韭菜 畢業
放空 下車 賣出 賣光 完蛋 住海景
""".split()
ALONE = {"多": 1, "噴": 1, "漲": 1, "空": -1, "崩": -1, "跌": -1}
TURNS = "不沒別未無"

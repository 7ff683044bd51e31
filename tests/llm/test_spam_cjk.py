"""Keyword pages in Chinese and Japanese, and prose in them."""

from tracelake.llm import spam

SPAM = [
    "、".join(["便宜机票预订", "特价机票", "机票预订网", "便宜机票", "机票特价预订", "北京机票预订"] * 8),
    "激安航空券 格安航空券 航空券予約 激安航空券予約 格安航空券比較 " * 10,
    "便宜机票预订网提供便宜机票。特价便宜机票预订首选便宜机票预订网！北京便宜机票预订,上海便宜机票预订,便宜机票特价。" * 5,
]
HAM = [
    "数据库连接池用于复用连接，从而减少建立连接的开销。每个请求从池中取出一个连接，使用完毕后归还。如果池中没有空闲连接，请求就会等待，直到超时为止。" * 2,
    "この関数は入力ファイルを読み込み、各行を解析してから結果をデータベースに保存します。エラーが発生した場合は、ログに記録して処理を続行します。",
    "".join(f"函数 f{i} 会检查每一条记录,然后写入 voucher 表。" for i in range(6)),
]


def test_share_of_keywords():
    assert all(spam.spam_share(t) > 0.5 for t in SPAM)
    assert all(spam.spam_share(t) == 0 for t in HAM)

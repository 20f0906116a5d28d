"""Explicit schemas of landed files."""

LEVELS = "array<struct<price:string,size:string,quantity:string>>"
TICK = f"""venue string, market_id string, market_slug string, event_type string, status string, exchange_timestamp string, received_at timestamp, sequence_id string,
last_price string, yes_bid string, yes_ask string, no_bid string, no_ask string, bid_size string, ask_size string, trade_size string, volume string, open_interest string, bids {LEVELS}, asks {LEVELS}"""
EVENT = """id string, slug string, title string, description string, category string, closed boolean, active boolean, volume24hr string, tags array<struct<label:string>>,
markets array<struct<id:string,conditionId:string,slug:string,question:string,status:string,volume:string,liquidity:string,openInterest:string,outcomes:string,outcomePrices:string,bestBid:string,bestAsk:string,lastTradePrice:string,clobTokenIds:string>>"""
MESSAGE = f"""event_type string, market string, asset_id string, timestamp string, hash string, status string, price string, size string, best_bid string, best_ask string, bid_size string, ask_size string,
winning_asset_id string, bids {LEVELS}, asks {LEVELS}"""
EXAMPLE = "run_id string, features map<string,double>, target double, predicted double, approved boolean"
EXPERIMENT = "task string, title string, dataset_version string, metrics map<string,double>, notes string, created_us long"

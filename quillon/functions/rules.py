"""Rule tables of the text screens.  Fixed values: results depend on these words and their order."""

from __future__ import annotations

# fixed values: area, task, pattern; the first narrow match of the list wins, then the first broad one
TASKS = [
    ("Portfolio Construction", "Index Tracking", r"index track|tracking error|enhanced index|replicat\w+ the index|sparse index"),
    ("Portfolio Construction", "Mean-Variance Optimization", r"mean.variance|markowitz|efficient frontier|minimum.variance|tangency portfolio"),
    ("Portfolio Construction", "Risk Parity and Allocation", r"risk parity|equal risk|budget\w* allocation|hierarchical risk|diversification ratio"),
    ("Portfolio Construction", "Tactical Asset Allocation", r"tactical|rotation|market timing|allocation rule|regime.aware portfolio|overlay|glide path|dynamic allocation"),
    ("Portfolio Construction", "Portfolio Optimization", r"portfolio|allocation|weights|kelly|utility maximi"),
    ("Forecasting", "Volatility Forecasting", r"volatilit\w* forecast|garch|realized volatilit|stochastic volatilit|variance forecast|\bHAR\b|vol.of.vol"),
    ("Forecasting", "Return Prediction", r"return predict|price predict|forecast\w* return|stock predict|directional forecast|equity premium"),
    ("Forecasting", "Regime Detection", r"regime|state.switching|markov switch|structural break|change.?point|phase transition|turning point"),
    ("Forecasting", "Time Series Foundation Models", r"foundation model|TimesFM|Chronos|zero.?shot forecast|pretrained.*time series"),
    ("Risk", "Value at Risk and Expected Shortfall", r"value.at.risk|\bVaR\b|expected shortfall|\bES\b forecast|backtesting risk|quantile risk|solvency"),
    ("Risk", "Tail Risk and Extremes", r"tail risk|heavy tail|extreme value|tail depend|rogue wave|black swan|tail index|hill estimator"),
    ("Risk", "Return Distributions", r"distribution of (stock |asset |financial )?returns|skew.?t|stable distribution|tempered|jones.faddy|fat.?tail\w* distribution|moment\w* of returns"),
    ("Risk", "Drawdown and Downside Control", r"drawdown|downside risk|loss control|capital preservation|CVaR|conditional value"),
    ("Asset Pricing", "Factor Models", r"factor model|fama.french|risk factor|characteristic\w* sorted|cross.section of (expected )?returns|principal component.*return"),
    ("Asset Pricing", "Anomaly Replication", r"anomal|predictor\w* librar|replicat\w+ .*(finding|result|anomal)|p.hacking|multiple testing|out.of.sample decay|open source asset pricing"),
    ("Asset Pricing", "Momentum and Reversal", r"momentum|trend follow|reversal|mean.revers|relative strength"),
    ("Asset Pricing", "Correlation Structure", r"correlation (matrix|structure|network)|covariance (matrix|estimat)|random matrix|eigenvalue|shrinkage estimat|network of (stocks|assets)"),
    ("Derivatives", "Option Pricing", r"option pricing|black.scholes|implied volatilit|volatility surface|levy process|heston|local volatilit|exotic option"),
    ("Derivatives", "Hedging", r"hedg\w+|delta.neutral|replication portfolio|greeks"),
    ("Derivatives", "Volatility Products", r"\bVIX\b|\bVXO\b|VSTOXX|variance swap|volatility index|term structure of vol"),
    ("Market Microstructure", "Optimal Execution", r"optimal execution|market impact|\bTWAP\b|\bVWAP\b|implementation shortfall|order splitting|almgren"),
    ("Market Microstructure", "Liquidity and Price Impact", r"liquidit|bid.ask spread|amihud|kyle.?s? lambda|price impact|market depth|order flow|market maker"),
    ("Alternative Data", "Sentiment Analysis", r"sentiment|news analytic|social media|investor attention|textual analysis|tone of|media coverage"),
    ("Alternative Data", "LLM Agents for Trading", r"\bLLM\b|large language model|agentic|\bGPT\b|\bClaude\b|language model.*(portfolio|trading|invest)"),
    ("Alternative Data", "Event Studies", r"event study|announcement effect|merger|acquisition|earnings surprise|abnormal return|insider tradin|form 4"),
    ("Crypto", "Crypto Asset Pricing", r"crypto|bitcoin|ethereum|digital asset|\bDeFi\b|token|stablecoin|on.chain"),
    ("Macro", "Term Structure", r"term structure|yield curve|interest rate model|bond yield|nelson.siegel"),
    ("Macro", "Macro-Financial Linkages", r"macro|inflation|monetary polic|central bank|exchange rate|business cycle|recession|\bGDP\b|unemployment"),
]
BROAD = ("Portfolio Optimization", "Macro-Financial Linkages", "Crypto Asset Pricing")
CATCH_ALL = ("Asset Pricing", "General")

# fixed values: topical tags, in the order in which three are kept
TAGS = [
    ("momentum", r"momentum|trend follow"),
    ("reversal", r"reversal|mean.revers"),
    ("volatility", r"volatilit|garch|realized vol"),
    ("machine-learning", r"machine learning|neural|deep learning|transformer|LLM|reinforcement"),
    ("options", r"option|implied vol|derivative pricing"),
    ("crypto", r"crypto|bitcoin|defi|blockchain|token"),
    ("portfolio", r"portfolio|allocation|optimi[sz]ation|risk parity"),
    ("microstructure", r"microstructur|limit order|high.frequenc|order flow"),
    ("factors", r"factor|cross.section|anomal|asset pricing"),
    ("risk", r"risk management|drawdown|tail risk|var\b|expected shortfall"),
    ("macro", r"macro|inflation|monetary|exchange rate|interest rate"),
    ("sentiment", r"sentiment|news|text|social media"),
]
DEFAULT_TAG = "quant-finance"

# fixed values: gates of the practical screen, in the order of their use
STRATEGY = (
    r"cross[- ]section|time[- ]series[^.]{0,40}return|stock returns|return predictab|predict(ing|s|ability|or)[^.]{0,40}(return|price|volatilit)|trading strateg|trading rule|investment strateg|portfolio|"
    r"risk factors?|factor (model|zoo|premi|investing|momentum)|risk premi|anomal|momentum|reversal|carry trade|value premium|low.volatility|betting against beta|alpha|signal|backtest|market timing|"
    r"volatilit|hedg(e|ing)|option pricing|implied vol|statistical arbitrage|pairs trading|mean.revers|machine learning|deep learning|neural network|past (returns|performance|winners)|asset allocation|term structure|"
    r"order flow|limit order book|execution (cost|algorithm)|transaction cost|expected shortfall|value at risk|drawdown|sharpe|illiquidity|liquidity risk|"
    r"asset pricing|bid[- ]ask|market maker|specialist market|term premium|stochastic volatility|jump diffusion|risk parity|tail risk|forecast"
)
ESSAY = (
    r"corporate governance|agency (cost|problem|theory)|board of directors|\bCEO\b|executive compensation|disclosure|earnings management|auditor|litigation|tax(ation)? (policy|avoidance|compliance)|regulatory reform|"
    r"bank(ing)? (supervision|regulation|stability|competition)|microfinance|financial (literacy|inclusion|education)|household finance|survey (evidence|of|data)|questionnaire|gender|diversity|political|"
    r"lobbying|law and (economics|finance)|climate|carbon|green (bond|return)|sustainab|ESG|corporate social respons|initial public offering process|monetary policy transmission|"
    r"fiscal|inequality|labor market|housing (market|price)|COVID|pandemic|sanctions|social (network|media)"
)
UNOBTAINABLE = (
    r"tick[- ]by[- ]tick|tick data|intraday|high[- ]frequency|millisecond|limit order book|order book|quote[- ]level|trade and quote|TAQ|option (chain|surface|panel)|implied volatility surface|OptionMetrics|"
    r"IvyDB|analyst (forecast|estimate|recommendation)|I/?B/?E/?S|institutional holdings|13F|short interest|securities lending|proprietary (data|dataset)|broker(age)? (records|accounts)|"
    r"credit default swap|CDS spread|corporate bond transaction|TRACE|mutual fund flows|hedge fund (holdings|returns database)|earnings call transcript|patent|satellite|credit card (transaction|panel)"
)
THEORY_ONLY = (
    r"we prove|existence and uniqueness|viscosity solution|mean field game|stochastic control problem|utility maximi[sz]ation problem|convergence (rate|theorem|analysis)|finite difference scheme|"
    r"numerical scheme|discreti[sz]ation error|asymptotic expansion|martingale representation|axiom|equilibrium existence|general equilibrium model"
)
LEAST_ABSTRACT = 260
# fixed values: reasons of the practical screen
REASONS = {
    "essay": "essay, governance, policy or disclosure, no mechanism",
    "unnamed": "no mechanism named in title or abstract",
    "data": "needs data we cannot fetch (",
    "theory": "theory, not a position (",
    "runnable": "runnable",
}

# fixed values: tri-state testability
TESTABLE = r"momentum|reversal|trend|moving average|cross.section|factor|anomal|volatilit|portfolio|calendar|seasonal"
NEEDS_MORE = r"option|implied|limit order|high.frequenc|microstructur|analyst|earnings call|proprietary|intraday|order flow|tick"

# fixed values: abstract screen
THEORY = (
    r"we\s+prove|\bproof\s+of\b|\btheorem\b|\blemma\b|\bcorollary\b|closed[- ]form\s+(solution|expression)|existence\s+and\s+uniqueness|viscosity\s+solution|Hamilton[- ]Jacobi|\bHJB\b|stochastic\s+control\s+problem|verification\s+theorem|"
    r"asymptotic\s+expansion|we\s+derive\s+(a|an|the)\s+(closed|explicit|analytic)|\bwell[- ]posedness\b|martingale\s+representation"
)
SYNTHETIC = (
    r"synthetic\s+(data|market|price|series)|simulated\s+(data|market|series)|Monte\s+Carlo\s+(study|experiments?|simulations?)|agent[- ]based\s+(model|simulation)|\bABM\b|"
    r"numerical\s+(experiments?|illustrations?)\s+(show|demonstrate|confirm)|simulation\s+study"
)
EMPIRICAL = (
    r"\bbacktest\w*|out[- ]of[- ]sample|\bS&P\s*500\b|\bNASDAQ\b|\bCRSP\b|\bDow\s+Jones\b|\bRussell\b|\bSTOXX\b|\bFTSE\b|\bNikkei\b|daily\s+(returns?|closes?|prices?)|historical\s+(data|prices?|returns?)|"
    r"real[- ]world\s+data|empirical(ly)?\s+(test|evaluat|validat|analys|studi|examin)|using\s+data\s+from|data\s+(spanning|covering|from)\s+\d{4}|\b(19|20)\d{2}\s*(to|-|none|through)\s*(19|20)\d{2}\b|"
    r"cross[- ]section\s+of\s+(stock|equity|asset)|\bWRDS\b|Fama[- ]French|\bCompustat\b|Yahoo\s+Finance|\bETFs?\b"
)

# fixed values: gaps of dropped papers; the first match wins
GAPS = [
    ("intraday / order book", r"order book|tick|intraday|high[- ]frequency|level-?1|LOB"),
    ("options surface", r"option (chain|surface)|implied vol|OptionMetrics|SPX|VIX"),
    ("vendor data", r"bloomberg|ravenpack|compustat|CRSP|WRDS|refinitiv|thetadata|dukascopy|cryptocompare|coin metrics|silicon data|proprietary"),
    ("crypto derivatives", r"binance|perpetual|funding rate|liquidation|on-chain|uniswap"),
    ("non-US market", r"chinese|shenzhen|A-share|warsaw|iranian|nifty|german power|IMF"),
    ("pure theory", r"pure theor|no empirical|theorem|proof|axiomat|no data"),
    ("synthetic only", r"synthetic|simulat|monte carlo|illustrative"),
    ("spec withheld", r"withheld|not (released|published|disclosed)|undisclosed"),
]

# fixed values: effort tiers
TRAINED = r"\bLSTM\b|\bGRU\b|transformer|neural|deep|reinforcement|\bRL\b|\bPPO\b|\bGCN\b|\bGNN\b|foundation model|fine-?tune|\bLLM\b|agentic"
FITTED = r"\bGARCH\b|\bEGARCH\b|\bMLE\b|Bayesian|\bMCMC\b|\bHMM\b|Markov|\bSVM\b|random forest|kernel|copula|GAMLSS|filter"
BIG_UNIVERSE = r"\b([1-9]\d{2,})\s+(stocks|names|constituents|equities|funds|assets)"

# fixed values: free sources as a rejection would name them, and the phrases around them
FREE = [
    ("Crypto Fear and Greed Index", r"fear\s*(and|&)\s*greed|alternative\.me"),
    ("CoinGecko", r"coingecko|coinmarketcap|crypto market cap|historical market cap"),
    ("World Bank indicators", r"world bank|\bWDI\b"),
    ("Wikipedia pageviews", r"wikipedia|pageview|search volume|attention proxy"),
    ("Yahoo international listings", r"korea|korean|\bKRX\b|chinese|china|A-share|shanghai|shenzhen|\bBIST\b|turkish|\bIBEX\b|spanish|vietnam|\bVN30\b|indian|\bNIFTY\b|japanese|\bTOPIX\b|hong kong|non-US (market|exchange|listing)"),
]
PAID = r"\bCRSP\b|\bCompustat\b|\bI/?B/?E/?S\b|Bloomberg|Refinitiv|RavenPack|OptionMetrics|\bTAQ\b|\bWRDS\b|tick data|order book|limit order|option chain|implied vol(atility)? surface|credit rating|analyst (estimate|consensus)|proprietary|internal (loss|risk|PnL)"
UNAVAILABLE = r"outside the (free|available)|not in the free|no free source|not (freely )?(available|obtainable|accessible|covered)|cannot be (obtained|sourced|got|retrieved)|(vintage|we|the stack) (does|do) not (cover|have|serve)|unavailable|beyond the free|out of reach"
CONCEDED = r"(are|is|were) free|free on|freely available|covered by|available (on|from|via)|vintage (covers|serves|has)|only build|prices? (are|is) (free|on)"

# fixed values: order of effort tiers
TIER_ORDER = ("S", "M", "L")

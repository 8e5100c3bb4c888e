"""Word lists for keyword normalization."""

from __future__ import annotations

# These word lists, patterns and weights must hold for results to be right.
# Every operator takes them as parameters, so other rule tables can be passed in.

KOREAN_STOPWORDS = (
    "그리고", "그러나", "근데", "그런데", "하지만", "또한", "또", "그래서", "그래도", "왜", "정말", "진짜", "너무", "약간", "조금", "그냥",
    "영상", "댓글", "제품", "경우", "부분", "정도", "관련", "사용", "이거", "저거", "그거", "이건", "저는", "우리는", "진짜로", "같아요",
    "합니다", "했어요", "합니다만", "하는데", "있어요", "없어요", "같음", "같다", "같은", "때문", "하나", "둘", "셋", "이번", "저번", "오늘",
    "내일", "어제", "여기", "저기", "그냥요", "이런", "그런", "저런", "좀", "많이", "매우", "혹시", "아마", "일단", "그리고요", "그래요", "네",
    "아니요", "입니다", "있습니다", "없습니다", "하세요", "해요", "했음", "그렇게", "정도의", "않아", "않고", "없고", "있고",
)

ENGLISH_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "did", "do",
    "does", "done", "for", "from", "had", "has", "have", "having", "he", "her", "here", "hers", "him",
    "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me", "more", "most", "my",
    "myself", "no", "nor", "not", "of", "on", "or", "our", "ours", "ourselves", "out", "over", "really",
    "so", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they",
    "this", "those", "through", "to", "too", "under", "up", "very", "was", "we", "were", "what", "when",
    "where", "which", "while", "who", "why", "will", "with", "would", "you", "your", "yours", "yourself",
    "yourselves", "years", "year", "month", "months", "day", "days", "thing", "things", "something",
    "anything", "everything", "review", "reviews", "video", "appliance", "brand", "washer", "dryer",
    "fridge", "refrigerator", "dishwasher", "machine", "machines", "appliances", "im", "dont", "cant",
    "didnt", "doesnt", "wasnt", "werent", "shouldnt", "wouldnt", "couldnt", "ive", "youre", "theyre",
    "thats", "theres", "whats", "ill", "id", "weve", "isnt", "arent", "wont", "hadnt",
)

GENERIC_EXCLUDE = ("문제", "이슈", "상태", "부분", "경험", "느낌", "후기")

UI_NOISE_TERMS = (
    "링크", "제품보기", "바로가기", "클릭", "상세보기", "자세히보기", "상단", "하단", "좌측", "우측", "중앙", "왼쪽", "오른쪽", "있음", "없음",
    "가능", "불가", "추천이유", "체감가", "보기", "구독", "좋아요", "알림", "추천", "공유", "재생", "채널", "동영상", "영상보기", "확인", "누르",
    "눌러", "ㅋㅋ", "ㅋㅋㅋ", "ㅎㅎ", "ㅎㅎㅎ", "ㅠㅠ", "ㅜㅜ", "ㅠㅠㅠ", "ㅜㅜㅜ", "ㄱㄱ", "ㄴㄴ", "ㄹㄹ", "ㅇㅇ", "ㅎㅎㅎㅎ", "ㅋㅋㅋㅋ",
    "감사", "감사합니다", "감사해요", "고맙습니다", "수고하셨습니다", "수고하세요", "잘봤습니다", "잘봤어요", "잘보고", "잘보겠습니다", "잘보고갑니다",
    "맞습니다", "맞아요", "그렇죠", "그렇네요", "그렇구나", "그렇군요", "궁금합니다", "궁금해요", "궁금한데", "알겠습니다", "알겠어요", "주세요", "해주세요",
    "알려주세요", "보여주세요", "좋은", "좋아", "좋고", "좋다", "좋네", "좋겠", "좋을", "좋습니다", "보고", "봤는데", "봤어", "봤다", "보면",
    "봐서", "쓰고", "쓰는", "쓰면", "써보", "써본", "하고", "했는데", "했다", "했어", "해서", "하니", "하면서", "한번", "아주", "엄청", "완전",
    "되게", "거의", "별로", "딱히", "꽤", "꽤나", "이번에", "요즘", "최근", "계속", "다시", "아직", "먼저", "처음", "다음", "마지막", "이후",
    "이전", "앞으로", "앞으로도", "아닌", "보는", "있는", "되는", "하는", "없는", "했는", "하면", "되면", "나는", "됩니다", "했습니다", "습니다",
    "하나요", "인가요", "건가요", "인데요", "거든요", "잖아요", "인데", "근데요", "그러면", "그래서요", "그런거", "이런거", "다만", "단지", "역시",
    "물론", "사람", "분들", "여러분", "우리", "저도", "나도", "자기", "누구", "생각", "가지", "나오", "들어", "시작", "해보", "해야", "리뷰",
    "광고", "광고했", "광고했다", "광고했다고", "모델", "잇섭", "잇섭님", "곽튜브", "곽튜브님", "유튜버", "유튜브", "확실히", "확실", "자주", "바로",
    "자가", "고려", "사용중", "구입", "구입했", "고장나서", "귀찮겠네요", "샀는데", "샀다", "샀어요", "있는데", "없이", "없어서", "있는데요", "없는데",
    "커서", "밤에", "낮에", "낮에도", "밤에도", "새벽에", "만에", "년만에", "개월만에", "달만에", "주만에", "일만에", "1년만에", "2년만에", "3년만에",
    "4년만에", "5년만에", "6개월만에", "1개월만에", "몇달만에", "몇년만에", "년째", "개월째",
    "달째", "주째", "생각하면", "생각해보면", "생각했는데", "생각이", "느껴지는", "느껴져요", "느껴짐", "이렇게", "저렇게", "그렇게해서", "하실", "하시는",
    "하셨는데", "가전", "가전제품",
)

BRAND_NOISE_TERMS = (
    "삼성", "엘지", "지이", "월풀", "다이슨", "위닉스", "쿠쿠", "코웨이", "보쉬", "밀레", "일렉트로룩스", "필립스", "아이로봇", "발뮤다",
)

KEYWORD_TRANSLATIONS = {
    "noise": "소음", "noisy": "소음", "loud": "소음", "quiet": "정숙성", "vibration": "진동", "vibrates": "진동",
    "delivery": "배송", "shipping": "배송", "install": "설치", "installation": "설치", "setup": "설치",
    "price": "가격", "pricing": "가격", "expensive": "가격부담", "refund": "환불", "return": "반품", "repair": "수리",
    "service": "고객지원", "support": "고객지원", "broken": "고장", "issue": "문제", "issues": "문제", "problem": "문제",
    "problems": "문제", "defect": "불량", "defective": "불량", "leak": "누수", "capacity": "용량", "smell": "냄새",
    "odor": "냄새", "cleaning": "세척", "drying": "건조성능", "washing": "세탁성능", "energy": "전기세", "bill": "전기세",
    "filter": "필터", "door": "도어", "rack": "선반", "cycle": "코스", "stain": "얼룩", "performance": "성능",
    "quality": "품질", "manual": "설명서", "wifi": "와이파이", "app": "앱연결", "cold": "냉각", "cooling": "냉각",
    "ice": "얼음", "drain": "배수", "draining": "배수",
}

KEYWORD_CANONICAL_ALIASES = {
    "통돌": "통돌이", "통돌이세탁기": "통돌이", "통돌세탁기": "통돌이", "topload": "통돌이", "top-loader": "통돌이",
    "toploader": "통돌이", "드럼세탁기": "드럼", "drumwasher": "드럼", "식세기": "식기세척기", "식기세기": "식기세척기",
    "식기세척": "식기세척기", "식세척기": "식기세척기", "lg틔운": "틔운", "엘지틔운": "틔운", "a/s": "as",
}

BUSINESS_KEEPWORDS = (
    "가격", "가격부담", "가성비", "배송", "설치", "사용성", "편의성", "세척", "건조성능", "세탁성능", "냄새", "소음", "진동", "발열", "고장",
    "불량", "문제", "누수", "환불", "반품", "수리", "고객지원", "전기세", "도어", "필터", "용량", "코스", "크기", "디자인", "내구성", "마감",
    "설치기사", "A/S", "AS", "브랜드", "얼룩", "품질", "성능", "앱연결", "와이파이", "설명서", "청소", "교체", "선반", "건조시간", "세탁시간",
    "소독", "살균", "건조", "세척력", "냉각", "온도", "얼음", "소비전력", "정숙성", "배수", "물튐", "설치비", "보증", "앱", "연동", "물샘",
    "탈수", "소음문제", "용량부족",
)

PRODUCT_KEYWORDS = (
    "통돌이", "드럼", "세탁기", "건조기", "냉장고", "식기세척기", "로봇청소기", "청소기", "틔운", "스타일러", "에어컨", "공기청정기", "정수기",
)

NOISE_SUFFIXES = ("보기", "클릭", "링크", "바로가기")

NOISE_VERB_SUFFIXES = (
    "했는데", "했어요", "합니다", "하는데", "있어요", "없어요", "됩니다", "인데요", "거든요", "잖아요", "나요", "ㅂ니다", "습니다", "해서요", "인가요",
    "건가요", "인데", "네요", "더라고", "더라구", "겠네요", "겠다", "었는데", "겠어요", "는데", "어서", "다고", "했고", "했다고", "지만",
)

KR_PARTICLE_SUFFIXES = (
    "은", "는", "이", "가", "을", "를", "와", "과", "랑", "로", "도", "만", "님", "을", "를", "이", "가", "에서", "에게", "으로",
    "에는", "에도", "에서도", "이나", "이라", "이고", "이랑", "처럼", "만큼", "까지", "부터", "보다", "한테", "에서의", "으로도", "이면",
)

# Words that a keyword summary never shows, words that weigh little in it, words dropped from the terms of an
# enrichment, and words that are blocked beside names.
SUMMARY_BLOCK = (
    "커서", "밤에", "지금", "요즘", "이번", "그냥", "진짜", "정말", "약간", "사람들", "이유", "이게", "그게", "저게", "못쓰겠고", "라고", "보니",
    "있고요", "좀더", "점점", "기본", "혹시", "대단한", "만들었네", "영상보고", "먹을수있고", "사고싶은데", "하지", "추측이긴", "파는",
)
SUMMARY_LOW_WEIGHT = (
    "드럼", "통돌이", "세탁기", "건조기", "냉장고", "식기세척기", "틔운", "스타일러", "에어컨", "공기청정기", "가전", "가전제품", "제품",
    "사람들", "이유", "지금", "요즘", "이번", "그냥", "진짜", "밤", "밤에", "커서", "때문", "이게", "그게", "못쓰겠고", "영상", "리뷰", "기능",
    "효과", "라고", "보니", "있고요", "좀더", "점점", "직접", "혹시",
)
SUMMARY_LOW_FACTOR = 0.12
ENRICHMENT_NOISE = (
    "영상", "리뷰", "제품", "효과", "기능", "사람들", "사람", "이유", "기본", "혹시", "정말", "진짜", "그냥", "라고", "보니", "있고요", "좀더",
    "점점", "직접", "대단한", "만들었네", "영상보고", "먹을수있고", "사고싶은데", "하지", "추측이긴", "파는",
)
NAME_BLOCK = (
    "커서", "밤에", "지금", "요즘", "이번", "그냥", "진짜", "정말", "약간", "사람들", "이유", "있고", "있음", "없는", "없음", "없이", "없어서",
    "때문", "처럼", "이게", "그게", "저게", "왜", "왜요", "왜죠", "어떻게", "뭐지", "뭔가", "못쓰겠고", "라고", "보니", "있고요", "좀더", "점점",
    "기본", "혹시", "대단한", "만들었네", "영상보고", "먹을수있고", "사고싶은데", "하지", "추측이긴", "파는",
)

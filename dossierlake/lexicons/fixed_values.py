"""Word lists and lookup tables that results depend on.

Every list keeps its natural order because first-match rules read it in that order.
"""

# Fixed values from here to the end of the file.
TOKEN_STOPWORDS = ('관련', '관련된', '찾아줘', '찾아', '있는', '내용', '검색', '근거', '사례', '문서', '페이지', '산출물', '제안서', '보고서', '보여줘', '알려줘', '포함',
 '포함된', '들어간', '및', '또는', '그리고', '대한', '위한', '기반')

KOREAN_SUFFIXES = ('으로', '에서', '에게', '까지', '부터', '하고', '이며', '이고', '이다', '와', '과', '을', '를', '이', '가', '은', '는', '에', '의', '로',
 '도', '만')

CHAPTER_SYNONYMS = {'현황분석': ('현황분석', '현황 분석', 'As-Is', 'ASIS', '업무현황', '시스템 현황', '환경분석', '환경 분석'),
 '기술동향분석': ('기술동향분석', '기술 동향', '기술동향', '동향분석', 'Technology Trend', '최신기술동향'),
 '목표모델': ('목표모델', '목표 모델', 'To-Be', 'TOBE', '미래모델', '개선모델', '목표 아키텍처', '목표아키텍처', '목표 아키텍쳐', '목표아키텍쳐'),
 '요구사항분석': ('요구사항분석', '요구사항 분석', '요구사항', 'Requirement', 'Requirements'),
 '이행계획': ('이행계획', '이행 계획', '추진계획', '로드맵', 'Roadmap', '실행계획', '전환계획')}

SENTENCE_MARKERS = ('한다', '한다.', '하여', '하고', '위해', '통해', '확보', '도출', '제시', '정의')

CANONICAL_CHAPTER_ALIASES = {'일반현황': ('일반현황', '일반 현황', '사업개요', '사업 개요', '제안개요', '회사현황', '제안사 일반'),
 '현황분석': ('현황분석', '현황 분석', 'As-Is', 'ASIS', '업무현황', '업무 현황', '시스템현황', '환경분석'),
 '정보기술동향': ('정보기술동향', '정보 기술 동향', '기술동향', '기술 동향', 'IT동향', '최신기술', '기술트렌드', 'Technology Trend'),
 '요구사항분석': ('요구사항분석', '요구사항 분석', '요구사항', 'Requirement', 'Requirements', '요구사항 정의'),
 '목표모델': ('목표모델', '목표 모델', '목표아키텍처', '목표 아키텍처', 'To-Be', 'TOBE', 'To Be', '목표시스템', '개선모델', '미래모델'),
 '이행계획': ('이행계획', '이행 계획', '추진계획', '추진 계획', '로드맵', 'Roadmap', '실행계획', '전환계획'),
 '비용산정': ('비용산정', '비용 산정', '소요예산', '소요 예산', '사업비', '견적', '산출내역', 'TCO', '총소유비용'),
 '투입인력': ('투입인력', '투입 인력', '참여인력', '참여 인력', '수행인력', '인력투입', '전담인력', '조직 및 인력', '수행조직'),
 '수행방법론': ('수행방법론', '수행 방법론', '방법론', '추진방법론', '개발방법론', '컨설팅 방법론'),
 '품질관리': ('품질관리', '품질 관리', '품질보증', '품질 보증', '테스트', '시험', '검증'),
 '보안관리': ('보안관리', '보안 관리', '정보보안', '개인정보보호', '접근통제', '권한관리'),
 '사업관리': ('사업관리', '사업 관리', '프로젝트관리', '프로젝트 관리', 'PMO', '일정관리', '위험관리')}

CANONICAL_SECTION_ALIASES = {'인프라 아키텍처': ('인프라', '인프라 아키텍처', '기술 인프라', '시스템 구성', '시스템 구성도', '서버 구성', '네트워크 구성'),
 '애플리케이션 아키텍처': ('애플리케이션 아키텍처', '어플리케이션 아키텍처', '응용 아키텍처', '애플리케이션 구조', '서비스 구조'),
 '데이터 아키텍처': ('데이터 아키텍처', '데이터 구조', '데이터 모델', '데이터 설계', 'DB 설계', '데이터 표준'),
 '보안 아키텍처': ('보안 아키텍처', '보안 구성', '정보보안', '접근통제', '권한관리', '개인정보보호'),
 '업무 아키텍처': ('업무 아키텍처', '업무 구조', '업무 프로세스', '프로세스 설계', '업무 개선'),
 '기술 동향': ('기술 동향', '기술트렌드', '최신 기술', '적용사례', '시사점'),
 '비용 산정 기준': ('비용 산정 기준', '산정 기준', '단가', '수량', '견적', '소요예산', 'TCO'),
 '인력 운영': ('인력 운영', '투입 계획', '참여 인력', '수행 조직', '역할 및 책임', '주요 경력')}

CANONICAL_SUBSECTION_ALIASES = {'DR/백업/이중화': ('DR', '재해복구', '재난복구', '장애복구', '백업', '이중화', 'DR센터', '재해복구센터', 'RTO', 'RPO'),
 '클라우드 비용': ('클라우드 비용', '비용산정', 'TCO', '총소유비용', '단가', '사용량', '라이선스', '운영비', '구축비'),
 '인력 경력': ('주요경력', '주요 경력', '유사사업', '유사 사업', '참여사업', '참여 사업', '수행경험', '수행 경험'),
 'MSA/컨테이너': ('MSA', '마이크로서비스', '마이크로 서비스', 'API Gateway', '서비스 메시', '컨테이너', 'Kubernetes', 'K8s'),
 '데이터 이관': ('데이터 이관', '마이그레이션', '전환', 'ETL', '데이터 검증', '데이터 정제'),
 '보안/권한': ('보안', '접근통제', '권한관리', '인증', '암호화', '개인정보보호')}

CHAPTER_ALIASES = {'현황분석': ('현황분석', '현황 분석', 'As-Is', 'ASIS', '업무현황', '시스템현황', '환경분석', '환경 분석'),
 '정보기술동향': ('정보기술동향', '정보 기술 동향', '기술동향', '기술 동향', '최신기술', '최신 기술', '트렌드', 'Technology Trend'),
 '목표모델': ('목표모델', '목표 모델', '목표 아키텍처', '목표아키텍처', 'To-Be', 'TOBE', 'To Be', '목표시스템', '목표 시스템', '미래모델', '개선모델',
          '설계', '구성도'),
 '요구사항분석': ('요구사항분석', '요구사항 분석', '요구사항', 'Requirement', 'Requirements'),
 '이행계획': ('이행계획', '이행 계획', '추진계획', '로드맵', 'Roadmap', '실행계획', '전환계획'),
 '투입인력': ('투입인력', '투입 인력', '참여인력', '참여 인력', '수행인력', '인력명단', '인력 명단', '인력투입계획'),
 '비용산정': ('비용산정', '비용 산정', '소요예산', '예산', '견적', '단가', '수량', 'TCO')}

ROLE_ALIASES = {'PM': ('PM', '프로젝트매니저', '프로젝트 매니저', '총괄PM', '사업관리자', '총괄책임자'),
 'PL': ('PL', '파트리더', '파트 리더', '프로젝트리더', '프로젝트 리더', '리더'),
 'TA': ('TA', 'Technical Architect', '테크니컬 아키텍트', '기술 아키텍트', '기술아키텍트'),
 'AA': ('AA', 'Application Architect', '애플리케이션 아키텍트', '응용 아키텍트'),
 'DA': ('DA', 'Data Architect', '데이터 아키텍트', '데이터아키텍트'),
 'DBA': ('DBA', 'Database Administrator', 'DB 관리자', '데이터베이스 관리자'),
 '개발': ('개발', '개발자', '프로그래머', '엔지니어'),
 '컨설턴트': ('컨설턴트', '컨설팅', 'Consultant', 'ISP 컨설턴트', '전략 컨설턴트')}

PROJECT_TYPE_ALIASES = {'ISP': ('ISP', '정보화전략계획', '정보화 전략 계획'),
 'ISMP': ('ISMP', '정보시스템 마스터플랜', '정보시스템마스터플랜'),
 'BPR': ('BPR', '업무재설계', '업무 재설계'),
 '구축': ('구축', '개발', '시스템 구축', '서비스 구축', '플랫폼 구축'),
 '운영': ('운영', '유지관리', '유지 보수', 'SM'),
 '감리': ('감리', '정보시스템 감리'),
 '컨설팅': ('컨설팅', '컨설턴트', 'consulting'),
 '전환': ('전환', '클라우드 전환', '마이그레이션', 'Migration'),
 '표준화': ('표준화', '데이터 표준화', '표준')}

GRADE_ALIASES = {'특급': ('특급', '특급기술자', '특급 기술자', '수석'),
 '고급': ('고급', '고급기술자', '고급 기술자', '책임'),
 '중급': ('중급', '중급기술자', '중급 기술자', '선임'),
 '초급': ('초급', '초급기술자', '초급 기술자', '주니어')}

PARTICIPATION_ALIASES = {'총괄': ('총괄', '총괄책임', '총괄 책임', '총괄PM'),
 '전담': ('전담', '전임', '전담인력'),
 '상주': ('상주', '상근', '현장상주'),
 '비상주': ('비상주', '비상근')}

DR_KEYWORDS = ('DR', 'Disaster Recovery', '재해복구', '재난복구', '장애복구', '업무연속성', 'BCP', 'BCM', '재해 복구', 'DR센터', '재해복구센터', '백업센터',
 '원격지', '백업', '복구', 'RTO', 'RPO', '복구목표시간', '복구목표시점', '이중화', 'Active-Active', 'Active-Standby', '소산', '복제',
 '스토리지 복제', 'DB 복제')

CLOUD_COST_KEYWORDS = ('클라우드', '클라우드 비용', '비용산정', '비용 산정', 'TCO', '총소유비용', 'FinOps', '단가', '수량', '금액', '견적', '소요예산', '구축비', '운영비',
 '유지관리비', '라이선스', '사용량', '사용량 기반', '과금', 'vCPU', '메모리', '스토리지', '트래픽', '네트워크 비용')

MSA_KEYWORDS = ('MSA', 'Microservice', '마이크로서비스', '마이크로 서비스', 'API Gateway', '서비스 메시', 'Service Mesh', 'Istio', '컨테이너',
 'Docker', 'Kubernetes', 'K8s', 'DevOps', 'CI/CD', '무중단 배포', 'Blue-Green', 'Canary', '분산 트랜잭션', 'Saga',
 'Event-driven', 'Kafka', '쿠버네티스')

STAFF_KEYWORDS = ('투입인력', '참여인력', '수행인력', '인력투입', '전담인력', '성명', '등급', '역할', '담당업무', '주요경력', '유사사업', '참여사업', '발주기관', '사업명',
 '참여기간', '참여율', 'PM', 'PL', 'TA', 'AA', 'DA', 'DBA', '컨설턴트', '특급', '고급', '중급', '초급')

STAFF_QUERY_TRIGGERS = ('인력', '경력', '경험', 'PM', 'PL', 'TA', 'AA', 'DA', 'DBA', '특급', '고급', '중급', '초급', '유사사업', '참여사업', '수행경험',
 '주요경력')

ORGANIZATION_SUFFIXES = ('공사', '공단', '청', '부', '처', '원', '연구원', '평가원', '재단', '위원회', '대학교', '병원', '협회')

COMMON_STAFF_TERMS = ('유사사업', '참여사업', '수행경험', '주요경력', '투입인력', '참여인력', '경력사항')

TECHNICAL_DOMAIN_KEYWORD_GROUPS = {'CLOUD': ('클라우드', 'Cloud', '클라우드 네이티브', '하이브리드 클라우드', '멀티 클라우드', 'IaaS', 'PaaS', 'SaaS', 'AWS', 'Azure',
           'GCP', 'NCP', 'CSP', 'VPC', 'Transit Gateway', 'Direct Connect', 'VPN', '로드밸런서', 'Auto Scaling',
           '오토스케일링', '서버리스'),
 'AI': ('AI', '인공지능', '머신러닝', 'Machine Learning', '딥러닝', 'LLM', 'RAG', '챗봇', '추천', '예측', '분류', 'OCR', '자연어처리',
        'NLP', 'MLOps', '모델 학습', '모델 서빙'),
 'DATA': ('데이터', '데이터 아키텍처', '데이터 모델', '데이터 표준', '데이터 품질', '데이터 거버넌스', '데이터 이관', '마이그레이션', 'ETL', 'ELT', 'DW',
          'Data Warehouse', 'Data Lake', 'Lakehouse', 'MDM', '메타데이터', '빅데이터', 'Kafka', 'Spark'),
 'SECURITY': ('보안', '정보보안', '개인정보보호', '접근통제', '권한관리', '인증', '인가', 'SSO', 'IAM', 'MFA', '암호화', '키관리', 'KMS',
              '망분리', '제로트러스트', 'Zero Trust', '취약점', '보안관제', 'SIEM'),
 'ARCHITECTURE': ('아키텍처', '인프라 아키텍처', '애플리케이션 아키텍처', '데이터 아키텍처', '보안 아키텍처', '업무 아키텍처', '시스템 구성', '시스템 구성도',
                  '목표모델', 'To-Be', '운영모델', '표준 아키텍처'),
 'INTEGRATION': ('API', 'OpenAPI', 'API Gateway', '인터페이스', '연계', 'ESB', 'EAI', '메시지 큐', 'Message Queue',
                 'Event-driven', '이벤트 기반', 'Kafka', 'REST', 'SOAP'),
 'DEVOPS': ('DevOps', 'CI/CD', 'GitOps', 'IaC', 'Terraform', 'Ansible', '컨테이너', 'Docker', 'Kubernetes', 'K8s',
            'Helm', '무중단 배포', 'Blue-Green', 'Canary', '서비스 메시', 'Istio'),
 'OBSERVABILITY': ('모니터링', '관제', '로그', 'APM', 'Tracing', '트레이싱', 'Metric', '메트릭', 'Prometheus', 'Grafana',
                   'ELK', 'OpenTelemetry', '장애 감지', '알림'),
 'DATABASE': ('DB', 'Database', 'RDBMS', 'PostgreSQL', 'Oracle', 'MySQL', 'MariaDB', 'NoSQL', 'Redis',
              'MongoDB', 'DB 복제', '샤딩', '파티셔닝', '백업', '복구'),
 'NETWORK': ('네트워크', 'DNS', 'L4', 'L7', '로드밸런싱', '방화벽', 'WAF', 'VPN', '전용회선', '라우팅', '서브넷', 'NAT', 'CDN')}

DOMAIN_KEYWORD_STOPWORDS = ('근거', '사례', '산출물', '문서', '페이지', '관련', '내용', '보고서', '제안서', '자료')

TECHNICAL_DESIGN_PHRASES = (('AI', ('ai', '인공지능', 'artificial intelligence')),
 ('클라우드네이티브', ('클라우드네이티브', '클라우드 네이티브', 'cloud native', 'cloud-native')), ('클라우드', ('클라우드', 'cloud')),
 ('MSA', ('msa', '마이크로서비스', '마이크로 서비스', 'microservice', 'micro-service')),
 ('API', ('api', 'openapi', '오픈api', '오픈 api')), ('API Gateway', ('api gateway', 'api 게이트웨이', 'apigateway')),
 ('컨테이너', ('컨테이너', 'container', 'docker', '도커')), ('Kubernetes', ('kubernetes', 'k8s', '쿠버네티스')),
 ('DevOps', ('devops', 'dev ops', '데브옵스')), ('CI/CD', ('ci/cd', 'cicd', 'ci cd', '지속적 통합', '지속적 배포')),
 ('IaC', ('iac', 'terraform', '테라폼', 'infrastructure as code')),
 ('서비스메시', ('서비스 메시', '서비스메시', 'service mesh', 'istio')), ('서버리스', ('서버리스', 'serverless', 'lambda')),
 ('오토스케일링', ('오토스케일링', 'auto scaling', 'autoscaling', '자동확장')),
 ('하이브리드클라우드', ('하이브리드 클라우드', '하이브리드클라우드', 'hybrid cloud')),
 ('멀티클라우드', ('멀티 클라우드', '멀티클라우드', 'multi cloud', 'multicloud')), ('SaaS', ('saas', '서비스형 소프트웨어')),
 ('PaaS', ('paas', '서비스형 플랫폼')), ('IaaS', ('iaas', '서비스형 인프라')), ('AWS', ('aws', 'amazon web services')),
 ('Azure', ('azure', '애저')), ('GCP', ('gcp', 'google cloud')), ('NCP', ('ncp', '네이버클라우드', 'naver cloud')))

RESEARCH_DOMAIN_PHRASES = (('연구개발', ('연구개발', 'r&d', 'rnd', 'research and development')),
 ('연구관리', ('연구관리', '연구 과제', '연구과제', '과제관리', '과제 관리')), ('연구비', ('연구비', '연구비관리', '연구비 관리')),
 ('IRIS', ('iris', '범부처 연구지원', '범부처통합연구지원')))

ARCHITECTURE_PHRASES = (('기술아키텍처', ('기술 아키텍처', '기술아키텍처')), ('애플리케이션아키텍처', ('애플리케이션 아키텍처', '어플리케이션 아키텍처', 'app architecture')),
 ('데이터아키텍처', ('데이터 아키텍처', '데이터아키텍처')), ('인프라아키텍처', ('인프라 아키텍처', '인프라아키텍처')),
 ('보안아키텍처', ('보안 아키텍처', '보안아키텍처')), ('연계아키텍처', ('연계 아키텍처', '연계아키텍처')), ('시스템구성', ('시스템 구성', '시스템구성', '구성도')),
 ('기능설계', ('기능 설계', '기능설계', '기능정의', '기능 정의')), ('데이터모델', ('데이터 모델', '데이터모델', '데이터 설계', '데이터설계')),
 ('인터페이스', ('인터페이스', 'interface', '연계')), ('운영모델', ('운영 모델', '운영모델')), ('보안설계', ('보안 설계', '보안설계')))

GENERIC_ANCHOR_TERMS = ('목표모델', '목표 모델', '목표아키텍처', '목표 아키텍처', '목표시스템', '목표 시스템', 'to-be', 'tobe', '미래모델', '개선모델', '모델', '목표', '설계',
 '아키텍처', '구조', 'isp', 'ismp', 'bpr', 'bprisp', 'bprismp', 'ispismp', 'api', 'gateway', 'cloud', 'native',
 '네이티브', '분석보고서', '종합보고서', 'iiac', '성과물', '제출', '발전법', '주요내용', 'rev', '버전관리', '번호', '원본제안사', '원본 제안사', '일반현황',
 '일반 현황', 'tsp', '컨설팅', '고도화', '전사', '제안요약', '제안요약서', '정성', '정량', '정성제안', '정량제안', '표지', '목차', '참고', '참조',
 '수행실적', '수립', '투입인력', '제안사', '컨소시엄', '중심', '구축', '통합', '기능', '업무', 'rnd', 'r&d')

DOMAIN_STOPWORDS = ('01', '02', '03', '04', '05', 'h', 'pdf', 'ppt', 'pptx', 'final', 'copy', '제안', '제안서', '제안요약', '제안요약서', '정성',
 '정량', '정성제안', '정량제안', '표지', '목차', '참고', '참조', '수행실적', '수립', '투입인력', '제안사', '컨소시엄', '보고서', '사업수행',
 '수행', '산출물', '최종', '초안', '본문', '별첨', '사본', '용역', '사업', '프로젝트', '목표모델', '목표아키텍처', '목표시스템', '설계', 'isp',
 'ismp', 'bpr', 'bprisp', 'bprismp', 'ispismp', '분석보고서', '종합보고서', 'iiac', '성과물', '제출', '발전법', '주요내용', 'rev',
 '버전관리', '번호', '원본제안사', '원본 제안사', '컨설팅', '고도화', '전사', '중심', '구축', '통합', '기능', '업무', 'rnd', 'r&d', '일반현황',
 '일반 현황', 'tsp')

ALLOWED_ACRONYMS = ('ai', 'msa', 'api', 'iris', 'aws', 'azure', 'gcp', 'ncp', 'saas', 'paas', 'iaas', 'devops', 'kubernetes',
 'openapi', 'docker', 'terraform', 'istio', 'lambda')

REQUIREMENT_SECTION_HINTS = ('컨설팅요구사항', '컨설팅 요구사항', '과업요구사항', '과업 요구사항', '상세요구사항', '상세 요구사항', '기능요구사항', '기능 요구사항', '비기능요구사항', '비기능 요구사항',
 '제안요청사항', '제안 요청사항', '제안요청 내용', '과업내용', '과업 내용', '과업범위', '과업 범위', '주요과업', '주요 과업', '제안요청', '요구사항', '수행내용',
 '수행 내용', '수행방안', '수행 방안', '컨설팅')

CONSULTING_CONTENT_HINTS = ('현황분석', '현황 분석', '환경분석', '환경 분석', '업무분석', '업무 분석', '목표모델', '목표 모델', '목표아키텍처', '목표 아키텍처', '이행계획', '이행 계획',
 'To-Be', 'TO-BE', '프로세스', '아키텍처', '정보화전략', '데이터아키텍처', '데이터 아키텍처', '기술아키텍처', '기술 아키텍처', '클라우드', '클라우드네이티브',
 'MSA', '마이크로서비스', 'API', '인터페이스', '연계', '보안', '데이터', '품질', '표준', '거버넌스', '마이그레이션', '전환')

REQUIREMENT_ACTION_HINTS = ('분석', '진단', '정의', '설계', '수립', '도출', '제시', '마련', '개선', '전환', '검토', '구성', '구체화')

ADMINISTRATIVE_HINTS = ('사업명', '용역명', '과제명', '사업기간', '용역기간', '계약기간', '수행기간', '사업예산', '추정가격', '배정예산', '입찰', '계약', '낙찰', '공고', '개찰',
 '제안서 제출', '제출기한', '제출 서류', '평가항목', '평가기준', '배점', '가격평가', '기술평가', '참가자격', '유의사항', '일반사항', '서식', '붙임', '목차',
 '표지', '문의처', '담당자', '보증금')

NOISE_KEYWORDS = ('사업명', '용역명', '과제명', '사업기간', '용역기간', '계약기간', '수행기간', '기간', '개월', '예산', '금액', '추정가격', '배정예산', '입찰', '계약',
 '낙찰', '제안요청서', '제안서', '평가', '평가항목', '배점', '제출', '서식', '붙임', '목차', '표지', '일반사항', '유의사항', '컨설팅', '구축', '사업',
 '용역', '수행', '목표모델', '목표아키텍처', '목표시스템', '설계', '수립', '전략', '방안', '통해', '추진', '단계별', '도출한다', '분석', '체계', '관리체계',
 '대상', '시스템', '전환')

PRIORITY_REQUIREMENT_PHRASES = (('클라우드네이티브', ('클라우드네이티브', '클라우드 네이티브', 'cloud native', 'cloud-native')), ('클라우드', ('클라우드', 'cloud')),
 ('MSA', ('msa', '마이크로서비스', '마이크로 서비스')), ('API', ('api', 'openapi', '오픈api', '오픈 api')),
 ('데이터아키텍처', ('데이터아키텍처', '데이터 아키텍처')), ('기술아키텍처', ('기술아키텍처', '기술 아키텍처')), ('보안아키텍처', ('보안아키텍처', '보안 아키텍처')),
 ('인터페이스', ('인터페이스', 'interface', '연계')), ('마이그레이션', ('마이그레이션', 'migration', '전환')),
 ('데이터거버넌스', ('데이터거버넌스', '데이터 거버넌스')), ('메타데이터', ('메타데이터', 'meta data', 'metadata')),
 ('데이터표준', ('데이터표준', '데이터 표준', '표준화')), ('데이터품질', ('데이터품질', '데이터 품질', '품질관리')))

"""Fixed values of question understanding and guards: phrases, patterns and rules as tables, no logic."""

from __future__ import annotations

# Openings of a request; the first that fits is taken off.
PROMPT_PREFIXES = ('^\\s*give\\s+me\\s+(?:papers?|works?)\\s+(?:which|that|about|on)\\s+',
 '^\\s*find\\s+(?:me\\s+)?(?:papers?|works?)\\s+(?:which|that|about|on)\\s+',
 '^\\s*show\\s+me\\s+(?:papers?|works?)\\s+(?:which|that|about|on)\\s+',
 '^\\s*what\\s+are\\s+(?:some\\s+)?(?:papers?|works?)\\s+(?:which|that|about|on)\\s+',
 '^\\s*is\\s+there\\s+any\\s+(?:work|paper)\\s+(?:which|that)\\s+',
 '^\\s*are\\s+there\\s+any\\s+(?:works|papers)\\s+(?:which|that)\\s+',
 '^\\s*could\\s+you\\s+(?:please\\s+)?(?:list|find|show|provide)\\s+(?:me\\s+)?(?:some\\s+)?(?:papers?|works?|research)\\s+(?:which|that|about|on)?\\s*',
 '^\\s*can\\s+you\\s+(?:please\\s+)?(?:help\\s+me\\s+)?(?:list|find|show|provide)\\s+(?:me\\s+)?(?:some\\s+)?(?:papers?|works?|research)\\s+(?:which|that|about|on)?\\s*',
 '^\\s*i\\s+(?:would\\s+like|want)\\s+to\\s+know\\s+(?:about|how|whether|if)?\\s*',
 '^\\s*please\\s+(?:list|find|show|provide)\\s+(?:me\\s+)?(?:some\\s+)?(?:papers?|works?|research)\\s+(?:which|that|about|on)?\\s*')

# What may stand before a phrase; all that fit are taken off in this order.
LEADING_NOISE = ('^(?:supporting|support|providing|provide)\\s+(?:the\\s+)?claim(?:\\s+that)?\\s+',
 '^(?:evidence|papers?|works?)\\s+(?:supporting|showing)\\s+(?:that\\s+)?',
 '^explaining\\s+why\\s+',
 '^(?:i\\s+)?(?:am\\s+)?looking\\s+for\\s+(?:research\\s+)?(?:papers?|works?)?\\s*',
 '^(?:i\\s+)?(?:would\\s+like|want)\\s+to\\s+(?:know|find)\\s+(?:how|whether|if|about|some)?\\s*',
 '^(?:could|can)\\s+you\\s+(?:please\\s+)?(?:help\\s+me\\s+)?',
 '^(?:help\\s+me\\s+)?search\\s+for\\s+(?:the\\s+)?(?:work|works|papers?|research)\\s+(?:related\\s+to)?\\s*',
 '^(?:list|find|show|provide)\\s+(?:me\\s+)?(?:all\\s+|some\\s+)?(?:papers?|works?|research)\\s*',
 '^(?:what\\s+are\\s+the\\s+)?(?:researches|research)\\s+(?:that\\s+)?',
 '^(?:do\\s+you\\s+)?know\\s+(?:some\\s+)?',
 '^(?:note\\s+that\\s+)?i\\s+am\\s+referring\\s+to\\s+',
 '^is\\s+there\\s+(?:any\\s+)?')

# What may stand behind a phrase; all that fit are taken off in this order.
TRAILING_NOISE = ('\\s+note$', '\\s+do$', '\\s+it$')

# Words of a request that say nothing of its subject.
PROMPT_NOISE = """give me paper papers work works which that show shows showing find result results using use used can could than any some there about related""".split()

# Short terms that stand for themselves, and the type of constraint that each is.
SHORT_TERMS = {'ai': 'model_or_entity',
 'ee': 'task_or_modality',
 'gnn': 'method_or_property',
 'gnns': 'method_or_property',
 'hotpotqa': 'task_or_modality',
 'imo': 'task_or_modality',
 'llm': 'model_or_entity',
 'llms': 'model_or_entity',
 'ner': 'task_or_modality',
 'qat': 'method_or_property',
 'rag': 'method_or_property',
 're': 'task_or_modality',
 'rlhf': 'method_or_property',
 'sft': 'method_or_property'}

# Last words of a phrase that is not complete.
DANGLING = """a an and as between by claim for from have has in inductive into knowledgeable multiple of on or such supporting systematically the to using via with""".split()

# Words too broad to make a topic.
GENERIC_TOPIC = """analysis approach data document learning method model network paper prediction research result study system task relationship relationships""".split()

# Phrases that are fragments.
FRAGMENTS = ('do not', 'demonstrate how', 'have explored', 'is there', 'i would like', 'i am referring', 'do you', 'cutting edge')

# How fragments begin.
FRAGMENT_STARTS = ('am looking for research', 'what are the researches')

# How fragments end.
FRAGMENT_ENDS = (' method do', ' supervised fine', ' based agent', ' financial task note')

# Known phrases by type of constraint, in order of precedence.
PATTERNS = {'method_or_property': ('scaling law',
                        'scaling laws',
                        'chain of thought',
                        'retrieval augmented generation',
                        'reinforcement learning',
                        'in context learning',
                        'instruction tuning',
                        'fine tuning',
                        'parameter efficient',
                        'knowledge distillation',
                        'contrastive learning',
                        'self supervised',
                        'graph neural network',
                        'causal inference',
                        'pre training',
                        'pretraining',
                        'pre train'),
 'model_or_entity': ('large language model',
                     'large language models',
                     'language model',
                     'language models',
                     'llm',
                     'bert',
                     'gpt',
                     'clip',
                     'transformer',
                     'diffusion model',
                     'stable diffusion',
                     'resnet',
                     'yolo',
                     'rtdetr',
                     'rt detr'),
 'data_condition': ('smaller dataset',
                    'small dataset',
                    'less data',
                    'fewer data',
                    'bigger dataset',
                    'larger dataset',
                    'more data',
                    'dataset size',
                    'data efficient',
                    'data efficiency',
                    'sample efficiency'),
 'performance_relation': ('better model', 'better models', 'better performance', 'improved performance', 'outperform', 'outperforms'),
 'task_or_modality': ('video text',
                      'image text',
                      'vision language',
                      'video language',
                      'multi module',
                      'multi modal',
                      'multimodal',
                      'text to sql',
                      'natural language to sql',
                      'question answering',
                      'semantic segmentation',
                      'object detection',
                      'information retrieval',
                      'recommendation',
                      'machine translation',
                      'speech recognition',
                      'code generation')}

# A phrase and what is searched along with it.
EXPANSIONS = (('scaling law', ('scaling laws', 'scaling behavior')),
 ('multi module', ('multi module model', 'multimodal model', 'multi modal model')),
 ('multi modal', ('multimodal', 'multimodal model')),
 ('multimodal', ('multi modal', 'multimodal model')),
 ('image text', ('image language', 'vision language', 'vision language model')),
 ('video text', ('video language', 'video language model', 'multimodal video')),
 ('text to sql', ('text-to-sql', 'nl2sql', 'natural language to sql')),
 ('retrieval augmented generation', ('RAG', 'retrieval augmented generation')),
 ('large language model', ('LLM', 'large language models')),
 ('vision language', ('vision-language', 'vision language model')),
 ('chain of thought', ('CoT', 'chain-of-thought')),
 ('reinforcement learning', ('RL', 'reinforcement learning')))

# Words that are no keywords.
KEYWORD_STOPS = """a an the and or of for to in on with without by from into over under between among using use uses used based via through that which what when where
who whose there their these those this such as any some work works paper papers study studies analyze analyzes analysis method methods model models
approach approaches task tasks can could would should does do did be is are was were been have has had about also including include includes related
research""".split()

# Words that no seed shares with a question.
SEED_STOPS = """a about all an and are as at be by can do for from give how i in is it me of on paper papers provide research show some that the their these to use
using what which with""".split()

# Names and phrases that anchor a question, by type.
KNOWN_ANCHORS = {'benchmark': ('HumanEval',
               'MBPP',
               'CodeContests',
               'code_contests',
               'HotpotQA',
               'MMLU',
               'GSM8K',
               'ImageNet',
               'MS COCO',
               'COCO',
               'SQuAD',
               'GLUE',
               'SuperGLUE',
               'TruthfulQA',
               'HellaSwag',
               'ARC-Challenge',
               'BigBench',
               'BIG-Bench'),
 'method': ('RLHF',
            'DPO',
            'SFT',
            'RAG',
            'LoRA',
            'QLoRA',
            'CoT',
            'chain-of-thought',
            'chain of thought',
            'in-context learning',
            'instruction tuning',
            'test-time training',
            'retrieval-augmented generation',
            'retrieval augmented generation',
            'knowledge distillation',
            'contrastive learning',
            'self-supervised learning',
            'reinforcement learning',
            'direct preference optimization'),
 'model': ('GPT-4', 'GPT-3', 'BERT', 'T5', 'LLaMA', 'Llama', 'LLaVA', 'CLIP', 'Stable Diffusion', 'Transformer', 'ViT', 'VLM', 'LLM'),
 'task': ('text-to-SQL',
          'text to SQL',
          'question answering',
          'code generation',
          'event extraction',
          'document-level event extraction',
          'semantic segmentation',
          'object detection',
          'machine translation',
          'information retrieval',
          'paper recommendation',
          'video generation',
          'robot task planning',
          'task planning',
          'robot decision making',
          'game playing',
          'computer control'),
 'modality': ('vision-language',
              'vision language',
              'video-language',
              'video language',
              'multimodal',
              'multi-modal',
              'audio-visual',
              'audio visual',
              '3D',
              'video',
              'image',
              'audio',
              'text')}

# Phrases of a request that anchor nothing.
NOT_ANCHORS = ('find papers',
 'find me papers',
 'show me',
 'give me papers',
 'help me find',
 'can you help me',
 'share insights',
 'i want to know',
 'recommend papers',
 'please find',
 'papers which',
 'papers that')

# Exclusions, and what each excludes.
NEGATIVE = (("\\b(?:exclude|excluding|without|do not include|don't include|not)\\s+(?:any\\s+)?(?:survey|surveys|review papers?|review articles?)\\b", 'exclude_survey'),
 ('\\b(?:non[- ]survey|non[- ]review)\\b', 'exclude_survey'),
 ("\\b(?:exclude|without|do not include|don't include)\\s+(?:any\\s+)?(?:preprints?|arxiv papers?)\\b", 'exclude_preprint'))

# Conditions on the year, and the relation of each.
TEMPORAL = (('\\b(?:after|since|from)\\s+(19\\d{2}|20\\d{2})\\b', 'year_from'),
 ('\\b(?:before|until|up to)\\s+(19\\d{2}|20\\d{2})\\b', 'year_to'),
 ('\\bbetween\\s+(19\\d{2}|20\\d{2})\\s+(?:and|to)\\s+(19\\d{2}|20\\d{2})\\b', 'year_range'),
 ('\\b(?:recent|latest|newest)\\s+(?:papers?|work|research)\\b', 'recent_only'))

# Comparisons, and the relation of each.
COMPARISON = (('\\b(?:harder|more difficult)\\s+than\\s+([^,.;]+?)\\s+(?:but|and)\\s+(?:easier|less difficult)\\s+than\\s+([^,.;?]+)', 'difficulty_between'),
 ('\\b(?:better|stronger|more accurate)\\s+than\\s+([^,.;?]+)', 'outperforms_anchor'),
 ('\\b(?:smaller|less|fewer)\\s+([^,.;]+?)\\s+than\\s+([^,.;?]+)', 'smaller_than'))

# Pattern in a question, what it is also called, type of anchor, type and priority of the plan.
ALIAS_RULES = (('\\bin[- ]context learning\\b.*\\b(?:pre[- ]?training|pretraining)\\b|\\b(?:pre[- ]?training|pretraining)\\b.*\\bin[- ]context learning\\b',
  ('in-context learning emergence during pretraining',
   'induction heads mechanism of in-context learning',
   'implicit learning mechanism for in-context learning'),
  'method',
  'method_alias',
  98),
 ('\\bmultimodal\\b.*\\b(?:visual|vision)\\b.*\\baudio\\b|\\baudio[- ]visual\\b.*\\b(?:foundation model|pre[- ]?train)',
  ('audio visual multimodal foundation model pretraining', 'vision audio foundation model large-scale pretraining'),
  'modality',
  'modality_composition',
  96),
 ('\\blong video (?:description|captioning)\\b|\\bvideos?\\b.*\\b(?:several minutes|minutes-long|long-form)\\b',
  ('long-form video captioning minutes-long video', 'dense video captioning long video description', 'movie description long video'),
  'task',
  'task_alias',
  96),
 ('\\btransformer\\b.*\\b3d\\b.*\\bvideo generation\\b|\\b3d\\b.*\\bvideo generation\\b.*\\btransformer\\b',
  ('transformer 3D video generation', 'transformer-based 4D dynamic scene generation'),
  'task',
  'task_method',
  97),
 ('\\btrigger[- ]free\\b.*\\bevent extraction\\b|\\bevent extraction\\b.*\\b(?:without|no)\\b.*\\btrigger',
  ('trigger-free document-level event extraction',
   'document event extraction without trigger annotations',
   'event extraction without human-annotated triggers'),
  'method',
  'task_method',
  99),
 ('\\bin[- ]context learning\\b.*\\b(?:supervised fine[- ]tun(?:e|ed|ing)?|sft)\\b.*\\b(?:information extraction|ner|re|ee)\\b',
  ('in-context learning versus supervised fine-tuning information extraction', 'LLM ICL NER RE EE small model comparison'),
  'comparison',
  'comparison_aware',
  98),
 ('\\bmultiple papers\\b.*\\b(?:survey|review)\\b|\\bwrite a survey\\b|\\brelationships between (?:multiple )?papers\\b',
  ('LLM automated literature review survey generation',
   'large language model multi-paper synthesis scientific survey writing',
   'scientific literature synthesis with language models'),
  'task',
  'task_alias',
  96),
 ('\\bsame prompt\\b.*\\bdifferent responses\\b|\\bmultiple responses\\b.*\\b(?:sft|fine[- ]tuning)\\b',
  ('multiple responses per prompt supervised fine-tuning', 'response diversity improves instruction tuning', 'multi-response instruction tuning'),
  'method',
  'method_alias',
  97),
 ('\\bcommon ?sense\\b.*\\bmachine translation\\b|\\bmachine translation\\b.*\\bcommon ?sense\\b',
  ('commonsense reasoning for machine translation', 'commonsense-aware neural machine translation', 'external knowledge machine translation commonsense'),
  'task',
  'task_alias',
  96),
 ('\\breinforcement learning\\b.*\\bdiffusion\\b.*\\bvideo generation\\b',
  ('reinforcement learning optimize diffusion video generation', 'reward fine-tuning diffusion model for text-to-video generation'),
  'method',
  'task_method',
  98),
 ('\\b(?:harder|more difficult) than\\b.*\\b(?:humaneval|mbpp)\\b.*\\b(?:easier|less difficult) than\\b.*\\b(?:code[_ ]?contests)\\b',
  ('code generation benchmark harder than HumanEval MBPP', 'program synthesis benchmark between HumanEval and CodeContests difficulty'),
  'comparison',
  'benchmark_comparison',
  100),
 ('\\bneural network(?: based)? quantum monte carlo\\b|\\bneural quantum states?\\b',
  ('neural network quantum Monte Carlo', 'neural quantum states variational Monte Carlo', 'deep neural quantum Monte Carlo'),
  'domain_entity',
  'exact_phrase',
  99),
 ('\\b3d\\b.*\\b(?:aigc|generative)\\b.*\\b(?:foundation models?|scene understanding)\\b|\\b3d scene understanding\\b.*\\b3d aigc foundation models?\\b',
  ('3D scene understanding generative foundation model', '3D AIGC foundation model scene understanding', '3D world model scene understanding'),
  'model',
  'model_alias',
  97),
 ('\\b(?:llm|large language model)\\b.*\\bquantized pre[- ]?training\\b|\\bquantized pre[- ]?training\\b.*\\b(?:llm|large language model)\\b',
  ('quantized pretraining large language model', 'low-bit quantization-aware LLM pretraining', 'low precision language model pretraining'),
  'method',
  'method_alias',
  99),
 ('\\bidentity (?:preservation|preserving|consistent)\\b.*\\bvideo generation\\b',
  ('identity-preserving video generation', 'subject-driven identity-consistent text-to-video generation', 'personalized video generation identity consistency'),
  'task',
  'task_alias',
  98),
 ('\\bimage encoding distributions?\\b',
  ('image latent representation distribution encoding', 'visual tokenization encoding distribution', 'image representation distribution learning'),
  'task',
  'ambiguity_split',
  92),
 ('\\bsynthetic data\\b.*\\b(?:long thought|reasoning)\\b|\\blong thought data\\b',
  ('synthetic long chain-of-thought data generation for LLM',
   'automatic high-quality reasoning trace data synthesis',
   'diverse difficult synthetic reasoning data language model'),
  'method',
  'task_alias',
  98),
 ('\\b(?:select frames?|frame selection)\\b.*\\bvideo understanding\\b|\\bvideo understanding\\b.*\\b(?:select frames?|frame selection)\\b',
  ('adaptive frame selection for video understanding',
   'keyframe sampling temporal token selection video understanding',
   'temporal token pruning video understanding'),
  'method',
  'task_method',
  98),
 ('\\bcrypto[- ]based private learning\\b|\\bprivacy[- ]preserving machine learning\\b',
  ('cryptographic privacy-preserving machine learning',
   'secure multiparty computation private machine learning',
   'homomorphic encryption privacy-preserving machine learning'),
  'domain_entity',
  'domain_alias',
  98),
 ('\\bcontrollability\\b.*\\bvideo generation\\b|\\bcontrollable video generation\\b',
  ('controllable video generation motion camera trajectory layout',
   'motion controlled text-to-video generation',
   'camera trajectory controlled video generation'),
  'task',
  'task_decomposition',
  95),
 ('\\brobot decision making\\b.*\\btask planning\\b.*\\b(?:datasets?|benchmarks?)\\b',
  ('robot task planning decision making datasets benchmarks',
   'embodied AI long-horizon planning benchmark',
   'robot planning benchmark dataset decision making'),
  'benchmark',
  'benchmark_aware',
  99),
 ('\\bllm agents?\\b.*\\bfinancial tasks?\\b|\\bagents?\\b.*\\b(?:finance|financial)\\b.*\\b(?:evaluat|benchmark)',
  ('LLM agent benchmark financial tasks', 'evaluation benchmark autonomous language agents for finance', 'financial agent benchmark large language model'),
  'benchmark',
  'benchmark_aware',
  99),
 ('\\b(?:mining|discovering) factors?\\b.*\\b(?:stock|financial|exchange)\\b|\\bstock exchange analysis\\b.*\\bfactors?\\b',
  ('large language model alpha factor mining stock market',
   'LLM quantitative factor discovery financial signals',
   'language model alpha signal generation quantitative finance'),
  'domain_entity',
  'domain_alias',
  98),
 ('\\bvision[- ]language models?\\b.*\\bagents?\\b.*\\b(?:pc )?games?\\b|\\bagents?\\b.*\\bplay\\b.*\\bgames?\\b',
  ('vision-language agent PC game playing', 'multimodal VLM agent computer game control', 'vision-language-action agent game playing'),
  'task',
  'task_method',
  99))

# Plural nouns of research texts brought to the singular.
SINGULAR = {'papers': 'paper',
 'models': 'model',
 'networks': 'network',
 'datasets': 'dataset',
 'methods': 'method',
 'systems': 'system',
 'agents': 'agent',
 'factors': 'factor',
 'signals': 'signal',
 'documents': 'document',
 'properties': 'property',
 'images': 'image',
 'videos': 'video',
 'tasks': 'task',
 'benchmarks': 'benchmark',
 'representations': 'representation',
 'embeddings': 'embedding'}

# Connectors peeled off the front of a phrase.
LEADING_CONNECTORS = """for on about using via""".split()

# Connectors peeled off its end.
TRAILING_CONNECTORS = """for on about with using via of in""".split()

# Words at which the rest of a question is cut into spans.
BOUNDARIES = """a an and any about for from give in me of on or paper recent related relevant research show some study that the to use using via which with work can
claim could explaining help know list please provide supporting want why""".split()

# Last words of a span that is not complete.
RESIDUAL_DANGLING = """a an and as between by for from have has in inductive into knowledgeable multiple of on or such systematically the to using via with""".split()

# Words that are no evidence by themselves.
EVIDENCE_GENERIC = """analysis approach data document learning method model network paper prediction result system task""".split()

# Names of one concept, under the name that stands for it.
ALIAS_GROUPS = {'large language model': ('large language model', 'large language models', 'llm', 'llms'),
 'graph neural network': ('graph neural network', 'graph neural networks', 'gnn', 'gnns'),
 'retrieval augmented generation': ('retrieval augmented generation', 'retrieval-augmented generation', 'rag'),
 'natural language to sql': ('natural language to sql', 'natural-language-to-sql', 'text to sql', 'text-to-sql', 'nl2sql'),
 'pre training': ('pre training', 'pre-training', 'pretraining', 'pre train'),
 'vision language': ('vision language', 'vision-language'),
 'video text': ('video text', 'video-text'),
 'image text': ('image text', 'image-text')}

# Data sets that a question may ask for, and how they are written.
DATASETS = {'HotPotQA': ['hotpotqa', 'hotpot qa'],
 'MS COCO': ['ms coco', 'coco dataset', 'microsoft coco'],
 'ActivityNet': ['activitynet', 'activity net'],
 'WebVid': ['webvid', 'web vid'],
 'AudioSet': ['audioset', 'audio set'],
 'VGGSound': ['vggsound', 'vgg sound'],
 'Ego4D': ['ego4d', 'ego 4d'],
 'HowTo100M': ['howto100m', 'how to 100m', 'howto 100m'],
 'MSR-VTT': ['msr vtt', 'msrvtt'],
 'ImageNet': ['imagenet', 'image net'],
 'MMLU': ['mmlu'],
 'GSM8K': ['gsm8k', 'gsm 8k'],
 'HumanEval': ['humaneval', 'human eval'],
 'MBPP': ['mbpp']}

# Methods that a question may ask for: groups of words of which a paper needs one each.
METHODS = {'RLHF': [['rlhf', 'reinforcement learning from human feedback']],
 'reward_shaping': [['reward shaping', 'shaped reward', 'reward shaping methods']],
 'autoregressive_transformer': [['autoregressive', 'auto regressive'], ['transformer', 'transformers']],
 'in_context_learning': [['in context learning', 'in context capability', 'icl']],
 'pre_training': [['pre training', 'pretraining', 'pre train', 'pretrained']],
 'reinforcement_learning': [['reinforcement learning', 'rl']],
 'llm_agent': [['large language model', 'large language models', 'llm', 'llms'], ['agent', 'agents']],
 'ranking_with_llm': [['rank', 'ranking', 'rerank', 'reranking'],
                      ['search result', 'search results', 'retrieval', 'search'],
                      ['llm', 'llms', 'large language model', 'large language models']]}

# How a question refuses surveys.
SURVEY_REFUSALS = ['exclude survey',
 'exclude surveys',
 'excluding survey',
 'not survey',
 'non survey',
 'non survey paper',
 'non survey papers',
 'exclude review',
 'excluding review',
 'not review']

# What marks a survey.
SURVEY_TERMS = ['survey', 'review', 'systematic review', 'comprehensive survey', 'literature review', 'overview', 'bibliometric']

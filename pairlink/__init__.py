"""Record linkage, deduplication and data preparation on PySpark DataFrames."""

from pairlink.functions.clean import clean, phonenumbers, value_occurence
from pairlink.functions.phonetic import phonetic, phonetic_algorithms
from pairlink.log import get_verbosity, logger, set_verbosity
from pairlink.operators.classify import (
    BaseClassifier, DriverModelClassifier, ECMClassifier, FellegiSunter, KerasAdapter, KMeansClassifier, LearningError, LogisticRegressionClassifier, NaiveBayesClassifier, NetworkModelClassifier,
    NotFittedError, PairClassifier, SKLearnAdapter, SparkMLClassifier, SVMClassifier, sum_rule,
)
from pairlink.operators.compare import Compare
from pairlink.operators.features import (
    BaseCompareFeature, Date, Exact, Feature, Frequency, FrequencyA, FrequencyB, Geographic, Numeric, RandomContinuous, RandomDiscrete, String, Variable, VariableA, VariableB,
)
from pairlink.operators.indexing import BaseIndexAlgorithm, Block, Full, Index, IndexAlgorithm, NeighbourhoodBlock, Random, SortedNeighbourhood, index_split, split_index
from pairlink.operators.measures import (
    accuracy, confusion_matrix, false_negatives, false_positives, fscore, full_index_size, max_pairs, precision, recall, reduction_ratio, specificity, true_negatives, true_positives,
)
from pairlink.operators.resolve import ConnectedComponents, OneToManyLinking, OneToOneLinking
from pairlink.operators.skew import balanced_aggregate, balanced_timeline, heavy_keys
from pairlink.options import describe_option, get_option, option_context, options, reset_option, set_option
from pairlink.plans.linkage import block_and_compare
from pairlink.records import RecordSet
from pairlink.session import ship
from pairlink.sources.annotation import read_annotation_file, write_annotation_file
from pairlink.sources.febrl import load_febrl1, load_febrl2, load_febrl3, load_febrl4, read_febrl, true_links
from pairlink.sources.generate import binary_vectors
from pairlink.sources.patterns import clear_data_home, get_data_home, load_patterns

load_krebsregister = load_patterns

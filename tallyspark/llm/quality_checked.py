"""Kinds of documents of the test corpus of scale 0.1, read and labelled by hand.

A third of each class was picked among the texts an earlier model was least sure of, the rest at random. They serve to
calibrate and to measure the model of :mod:`tallyspark.llm.quality`, never to train it.
"""

CHECKED = {
    "prose": (
        "363 1144 1288 1536 1601 1759 1770 1785 1794 1829 1944 1955 2009 2218 2298 2518 2565 2868 3420 3621 3661 3689 3708 3953 4143 4319 4347 4539 4624 4707 "
        "4762 4776 4819 4938 5262 5406 5491 6349 6470 6605 6681 7031 7092 7354 7418 7952 8090 8739 9112 9272 9381 10085 10175 10278 10386 10866 10910 10941 "
        "11129 11408 11429 11595 11748 11768 11786 11845 12425 12559 12561 12656 12714 12888 13001 13519 13894 14055 14318 14398 14768 14824 14851 14910 14977 "
        "15160 15332 15575 15595 15600 15668 15706 15852 16137 16264 16268 16609 16635 16672 16684 16704 16914 17374 17393 17642 17837 18160 18359 18392 18707 "
        "18865 19226 19266 19623 19671 19742 19884 20003 "
    ),
    "list": (
        "266 859 867 919 964 978 1056 1184 1417 1555 2024 2042 2409 2814 2977 3257 3355 3365 3449 3623 3684 4302 4353 4472 4729 4878 5237 5260 5309 5527 5613 "
        "5652 5914 6096 6538 6834 7124 7542 7612 7776 7856 8387 8445 8465 8818 9145 9167 9293 9506 9713 9749 9908 9958 10656 10686 10697 10706 10842 10880 "
        "11016 11535 11829 11861 12280 12470 13008 13676 13880 13972 14207 14257 14307 14468 14622 14831 15107 15178 15542 15960 16145 16551 16713 16757 16911 "
        "17330 17522 17947 17956 18170 18177 18186 18314 18512 18739 18993 19132 19191 19296 19416 19559 19632 19685 19841 19990 "
    ),
    "table": (
        "1179 1659 1883 1896 2197 2385 2604 2634 3412 3716 3915 4171 4222 4244 4581 4672 4773 5109 5252 5303 5520 5832 6090 6223 6366 6586 6615 7007 7283 8373 "
        "8455 8536 8944 9343 9541 9578 9714 9730 10567 10674 10802 10850 11259 11291 11598 11869 11903 11987 12076 12111 12201 12388 12637 12962 12971 13337 "
        "13347 13538 13593 13640 13841 14178 14180 14363 14680 14755 15049 15118 15520 15627 15940 16258 16380 16400 16547 17006 17086 17231 17284 17310 17478 "
        "17550 17735 17810 17828 17850 17968 18005 18347 18386 19511 19519 19620 19794 20060 "
    ),
    "junk": (
        "129 842 1359 1729 1888 2090 2700 3093 3238 3331 3362 3377 3395 3534 3591 3826 3889 4043 4185 4314 4428 4528 4544 4577 5003 5130 5219 5326 5691 6343 "
        "6527 6541 6919 6964 7026 8068 8126 8277 8626 8656 8774 8968 9271 9668 9985 10139 10188 10241 10353 10848 11400 12081 12203 12292 12352 12543 12663 "
        "13181 13324 13452 13616 13647 13847 14523 14726 14816 14856 14865 15045 15462 15559 15688 15772 15822 15953 16070 16217 16277 16851 16853 16892 16981 "
        "17176 17313 17705 17736 17939 18092 18259 18396 18487 18744 19144 19725 19733 "
    ),
}


def checked() -> dict[int, str]:
    """Kind by ``doc_id``."""
    return {int(i): kind for kind, ids in CHECKED.items() for i in ids.split()}
